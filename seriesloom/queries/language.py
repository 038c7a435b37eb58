"""One query per function of the language over the events table, with its SQL.

The series are `shop.<type>.g<user mod 3>` with tags `grp` and `type`: hourly sums
over thirty days. `FULL` requests all of them; `LATE` begins a week later, so that
what looks back finds values there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0, T1 = 1704067200, 1706659200
FULL, LATE = (T0, T1), (T0 + 7 * 86400, T1)
ALL = "shop.*.*"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def digits(c: str = "value", off: float = 0.0):
    """Six decimals; sums of doubles depend on their order. `off` moves values that are halves of the last decimal."""
    return (F.round(F.col(c) + F.lit(off), 6) + F.lit(0.0)).alias(c)


def run(spark: SparkSession, d: str, target: str, span: tuple[int, int] = FULL, **options) -> DataFrame:
    from ..plans.engine import Engine
    from ..sources import tables

    more = {k: f(spark) for k, f in options.pop("lookups", {}).items()}
    engine = Engine(spark, tables.events(spark, d), lookups=more, **options)
    return engine.render(target, *span, now=T1)


def add(name: str, target: str, sql: str | None, span: tuple[int, int] = FULL, order: bool = False, times: bool = True, off: float = 0.0, **options) -> None:
    cols = ["name"] + (["ts"] if times else []) + (["ord"] if order else [])

    def query(spark: SparkSession, d: str) -> DataFrame:
        return run(spark, d, target, span, **options).select(*cols, digits(off=off))

    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


NAME = "'shop.' || event_type || '.g' || (user_id % 3) || ';grp=g' || (user_id % 3) || ';type=' || event_type"


def points(lo: int = T0, hi: int = T1) -> str:
    """The table `pts`: name, et, gr, path, ord, ts, v, i on the grid of a range."""
    return f"""raw as (select {NAME} as name, event_type as et, 'g' || (user_id % 3) as gr, epoch(date_trunc('hour', ts))::bigint as ts, sum(value) as v
  from events where epoch(ts) >= {lo} and epoch(ts) < {hi} group by all),
names as (select name, et, gr, 'shop.' || et || '.' || gr as path, row_number() over (order by name)::int as ord from (select distinct name, et, gr from raw)),
pts as (select n.name, n.et, n.gr, n.path, n.ord, t.ts, r.v, (t.ts - {lo}) // 3600 as i from names n cross join (select unnest(range({lo}, {hi}, 3600)) as ts) t
  left join raw r on r.name = n.name and r.ts = t.ts)"""


_PTS = points()
W = "(partition by name order by ts)"


def each(expr: str, name: str, src: str = "pts", where: str = "true", ctes: str = "", span: tuple[int, int] = FULL) -> str:
    head = _PTS if span == FULL else points(*span)
    return f"with {head}{',' + ctes if ctes else ''} select {name} as name, ts, round({expr}, 6) + 0.0 as value from {src} where {where}"


def called(fn: str, *rest: str) -> str:
    tail = "".join("," + r for r in rest).replace("'", "''")
    return f"'{fn}(' || name || '{tail})'"


# -- point by point ---------------------------------------------------------------


def _scalar() -> None:
    down = "offset({},-200)".format(ALL)
    named = lambda fn, inner: f"'{fn}(' || {called(*inner)} || ')'"
    add("fn_absolute", f"absolute({down})", each("abs(v - 200)", named("absolute", ("offset", "-200"))))
    for fn in ("add", "offset"):
        add(f"fn_{fn}", f"{fn}({ALL},10.5)", each("v + 10.5", called(fn, "10.5")))
    add("fn_scale", f"scale({ALL},2.5)", each("v * 2.5", called("scale", "2.5")))
    t = T0 + 864000
    add("fn_scaleAfterTimestamp", f"scaleAfterTimestamp({ALL},2.5,{t})", each(f"case when ts >= {t} then v * 2.5 else v end", called("scaleAfterTimestamp", "2.5", str(t))))
    add("fn_scaleToSeconds", f"scaleToSeconds({ALL},60)", each("v * 60 / 3600", called("scaleToSeconds", "60")))
    add("fn_invert", f"invert({ALL})", each("case when v <> 0 then 1 / v end", called("invert")))
    add("fn_pow", f"pow({ALL},1.5)", each("pow(v, 1.5)", called("pow", "1.5")))
    add("fn_squareRoot", f"squareRoot({down})", each("case when v >= 200 then sqrt(v - 200) end", named("squareRoot", ("offset", "-200"))))
    for fn in ("log", "logarithm"):
        add(f"fn_{fn}", f"{fn}({ALL})", each("case when v > 0 then ln(v) / ln(10) when v = 0 then '-infinity'::double end", called("logarithm")))
    add("fn_log_base2", f"log({ALL},2)", each("case when v > 0 then ln(v) / ln(2) when v = 0 then '-infinity'::double end", called("logarithm", "2")))
    add("fn_exp", f"exp(scale({ALL},0.01))", each("exp(v * 0.01)", named("exp", ("scale", "0.01"))))
    add("fn_logit", f"logit(scale({ALL},0.002))", each("case when v * 0.002 > 0 and v * 0.002 < 1 then ln(v * 0.002 / (1 - v * 0.002)) when v = 0 then '-infinity'::double end", named("logit", ("scale", "0.002"))))
    add("fn_sigmoid", f"sigmoid(scale({ALL},0.01))", each("1 / (1 + exp(-v * 0.01))", named("sigmoid", ("scale", "0.01"))))
    add("fn_round", f"round({ALL},1)", each("round_even(v * 10, 0) / 10", called("round", "1")))
    for fn in ("isNotNull", "isNonNull"):
        add(f"fn_{fn}", f"{fn}({ALL})", each("(v is not null)::int::double", called("isNonNull")))
    add("fn_transformNull", f"transformNull({ALL},-1)", each("coalesce(v, -1)", called("transformNull", "-1")))
    seen = "seen as (select distinct ts as rts from pts where et = 'click' and gr = 'g0' and v is not null)"
    add("fn_transformNull_reference", f"transformNull({ALL},-1,referenceSeries=shop.click.g0)", each("case when rts is not null then coalesce(v, -1) else v end", called("transformNull", "-1"), "pts left join seen on rts = ts", ctes=seen))
    add("fn_offsetToZero", f"offsetToZero({ALL})", each("v - min(v) over (partition by name)", called("offsetToZero")))
    lo, hi = "min(v) over (partition by name)", "max(v) over (partition by name)"
    add("fn_minMax", f"minMax({ALL})", each(f"case when v is not null then case when {hi} = {lo} then 0.0 else (v - {lo}) / ({hi} - {lo}) end end", called("minMax")))
    for fn in ("lowPass", "lpf"):
        add(f"fn_{fn}", f"{fn}({ALL},40)", each("case when i < 144 or i >= 720 - 144 then v end", called(fn, "40")))
    a, b = T0 + 5 * 86400, T0 + 9 * 86400
    add("fn_timeSlice", f"timeSlice({ALL},'{a}','{b}')", each(f"case when ts between {a} and {b} then v end", called("timeSlice", str(a), str(b))))
    add("fn_delay", f"delay({ALL},3)", each(f"lag(v, 3) over {W}", called("delay", "3")))
    add("lang_pipe", f"{ALL}|scale(2)|offset(1)", each("v * 2 + 1", named("offset", ("scale", "2")).replace("|| ')'", "|| ',1)'")))
    add("lang_macro", f"twice({ALL})", each("v * 2", called("scale", "2")), macros={"twice": "scale({0},2)"})


# -- along the series -------------------------------------------------------------


def _sequential() -> None:
    prev = "last_value(v ignore nulls) over (partition by name order by ts rows between unbounded preceding and 1 preceding)"
    add("fn_derivative", f"derivative({ALL})", each(f"v - {prev}", called("derivative")))
    d = f"v - lag(v) over {W}"
    add("fn_nonNegativeDerivative", f"nonNegativeDerivative({ALL})", each(f"case when {d} >= 0 then {d} end", called("nonNegativeDerivative")))
    wrap = f"case when {d} >= 0 then {d} when {d} is not null and v <= 5000 then 5000 - lag(v) over {W} + v + 1 end"
    add("fn_nonNegativeDerivative_max", f"nonNegativeDerivative({ALL},5000)", each(wrap, called("nonNegativeDerivative", "5000")))
    add("fn_perSecond", f"perSecond({ALL})", each(f"case when {d} >= 0 then ({d}) / 3600 end", called("perSecond")))
    run_sum = "sum(v) over (partition by name order by ts rows unbounded preceding)"
    add("fn_integral", f"integral({ALL})", each(f"case when v is not null then {run_sum} end", called("integral")))
    add("fn_integralByInterval", f"integralByInterval({ALL},'1d')", each(f"sum(coalesce(v, 0)) over (partition by name, (ts - {T0}) // 86400 order by ts rows unbounded preceding)", called("integralByInterval", "'1d'")))
    seg = """rs as (select distinct ts as rts from pts where et = 'click' and gr = 'g0' and v is not null and v <> 0),
sg as (select p.*, r.rts, count(r.rts) over (partition by p.name order by p.ts rows unbounded preceding) as g from pts p left join rs r on r.rts = p.ts)"""
    add("fn_integralWithReset", f"integralWithReset({ALL},shop.click.g0)", each("case when rts is not null then 0.0 when v is not null then sum(case when rts is null then v else 0 end) over (partition by name, g order by ts rows unbounded preceding) end", called("integralWithReset", "shop.click.g0"), "sg", ctes=seg))
    add("fn_changed", f"changed({ALL})", each(f"coalesce((v <> {prev})::int::double, 0)", called("changed")))
    last = "last_value(v ignore nulls) over (partition by name order by ts rows between unbounded preceding and current row)"
    add("fn_keepLastValue", f"keepLastValue({ALL})", each(last, called("keepLastValue")))
    gaps = "gp as (select *, count(v) over (partition by name order by ts rows unbounded preceding) as g from pts), gq as (select *, row_number() over (partition by name, g order by ts) - case when g > 0 then 1 else 0 end as k from gp)"
    add("fn_keepLastValue_limit", f"keepLastValue({ALL},2)", each("case when k <= 2 then first_value(v) over (partition by name, g order by ts) end", called("keepLastValue", "2"), "gq", ctes=gaps))
    heads = gaps + ", hd as (select name as hname, g as hg, v as a, lead(v) over (partition by name order by g) as b from gq where v is not null), sz as (select name as sname, g as sg, max(k) as size from gq group by all)"
    for q, target, lim, nm in (("fn_interpolate", f"interpolate({ALL})", "true", called("interpolate")), ("fn_interpolate_limit", f"interpolate({ALL},2)", "size <= 2", called("interpolate", "2"))):
        add(q, target, each(f"coalesce(v, case when {lim} then a + (b - a) * k / (size + 1) end)", nm, "gq left join hd on hname = name and hg = g left join sz on sname = name and sg = g", ctes=heads))
    # a period is the distance of the first two values, if a third follows at that distance with absent neighbours
    gaps = f"""with {_PTS}, nb as (select *, lag(v) over {W} as b, lead(v) over {W} as f from pts), sn as (select *, row_number() over {W} as k from pts where v is not null),
tw as (select name, min(i) as i1, max(i) as i2, max(i) - min(i) as g from sn where k <= 2 group by 1 having count(*) = 2),
pd as (select t.* from tw t join nb on nb.name = t.name and nb.i = t.i2 + t.g where g > 1 and nb.i <= 718 and v is not null and b is null and f is null)
select 'compressPeriodicGaps(' || p.name || ')' as name, case when g is null then ts else {T0} + i1 * 3600 + (ts - {T0} - i1 * 3600) // (g * 3600) * g * 3600 end as ts, round(arg_max(v, case when v is not null then ts end), 6) + 0.0 as value
from pts p left join pd on pd.name = p.name where g is null or i >= i1 group by all"""
    add("fn_compressPeriodicGaps", f"compressPeriodicGaps({ALL})", gaps)
    add("fn_cumulative", f"cumulative({ALL})", each("v", called("consolidateBy", '"sum"')))
    seq = "pr as (select *, row_number() over (partition by name order by ts) as n from pts where v is not null), em as (select a.name as ename, a.ts as ets, sum(case when b.n = 1 then pow(0.7, a.n - 1) * b.v else 0.3 * pow(0.7, a.n - b.n) * b.v end) as m from pr a join pr b on a.name = b.name and b.n <= a.n group by all)"
    for fn in ("ewma", "exponentialWeightedMovingAverage"):
        add(f"fn_{fn}", f"{fn}({ALL},0.3)", each("m", called(fn, "0.3"), "pts left join em on ename = name and ets = ts", ctes=seq))
    # the first ten values seed the average; later present ones follow
    lo = LATE[0] - 10 * 3600
    k = 2.0 / 11
    ema = f"""with {points(lo, T1)}, sd as (select name as sname, sum(coalesce(v, 0)) / 10 as e0 from pts where i < 10 group by all),
pr as (select *, row_number() over (partition by name order by ts) as n from pts where v is not null and i >= 10),
em as (select a.name as ename, a.ts as ets, max(e0) * pow({1 - k!r}, a.n) + sum({k!r} * pow({1 - k!r}, a.n - b.n) * b.v) as m from pr a join pr b on a.name = b.name and b.n <= a.n join sd on sname = a.name group by a.name, a.ts, a.n)
select {called("exponentialMovingAverage", "10")} as name, ts, round(round(m, 6), 6) + 0.0 as value from pts left join em on ename = name and ets = ts where i >= 10"""
    add("fn_exponentialMovingAverage", f"exponentialMovingAverage({ALL},10)", ema, LATE)
    # level, trend, and a list per series whose first element is the effect (deviation) of the slot at hand
    alpha, beta, gamma, off = 0.1, 0.0035, 0.1, 3e-9
    hw = f"""with recursive {_PTS}, hw as (
  select name, i, v, v as pred, 0.0::double as dev, v as level, 0.0::double as trend, v as ahead, list_transform(range(24), lambda k: 0.0::double) as eff, list_transform(range(24), lambda k: 0.0::double) as usual from pts where i = 0
  union all
  select name, i, v, pred, dev, level, trend, level + trend + eff[1] as ahead, eff, usual from (
    select name, i, v, pred, d as dev, lv as level, case when v is null then 0.0 else {beta} * (lv - old) + {1 - beta!r} * t0 end as trend,
      e0[2:24] || [case when v is null then 0.0 else {gamma} * (v - lv) + {1 - gamma!r} * e0[1] end] as eff, u0[2:24] || [d] as usual from (
      select *, {alpha} * (v - e0[1]) + {1 - alpha!r} * (old + t0) as lv, case when v is null then 0.0 else {gamma} * abs(v - coalesce(pred, 0.0)) + {1 - gamma!r} * u0[1] end as d from (
        select p.name, p.i, p.v, h.ahead as pred, h.eff as e0, h.usual as u0, h.trend as t0, coalesce(h.level, p.v) as old from hw h join pts p on p.name = h.name and p.i = h.i + 1)))),
out as (select name, {T0} + i * 3600 as ts, v, pred, pred - 3 * dev as lo, pred + 3 * dev as hi from hw where i >= 168)"""
    add("fn_holtWintersForecast", f"holtWintersForecast({ALL})", f"{hw} select {called('holtWintersForecast')} as name, ts, round(pred + {off}, 6) + 0.0 as value from out", LATE, off=off)
    for fn in ("holtWintersConfidenceBands", "holtWintersConfidenceArea"):
        add(f"fn_{fn}", f"{fn}({ALL})", f"{hw} select {called('holtWintersConfidenceLower')} as name, ts, round(lo + {off}, 6) + 0.0 as value from out union all select {called('holtWintersConfidenceUpper')}, ts, round(hi + {off}, 6) + 0.0 from out", LATE, off=off)
    add("fn_holtWintersAberration", f"holtWintersAberration({ALL})", f"{hw} select {called('holtWintersAberration')} as name, ts, round(case when v > hi then v - hi when v < lo then v - lo else 0.0 end + {off}, 6) + 0.0 as value from out", LATE, off=off)


# -- frames -----------------------------------------------------------------------


def _moving() -> None:
    def framed(agg: str, n: int, name: str, xff: float = 0.0, empty: str = "v") -> str:
        lo = LATE[0] - n * 3600
        w = f"(partition by name order by ts rows between {n - 1} preceding and current row)"
        value = agg.format(w=w)
        value = f"case when count(v) over {w} > 0" + (f" and count(v) over {w} / {n}.0 >= {xff}" if xff else "") + f" then {value} end"
        return f"with {points(lo, T1)}, m as (select name, ts, {value} as v from pts) select {name} as name, ts, round(v, 6) + 0.0 as value from m where ts >= {LATE[0]}"

    for fn, agg in (("movingAverage", "avg"), ("movingMin", "min"), ("movingMax", "max"), ("movingSum", "sum")):
        add(f"fn_{fn}", f"{fn}({ALL},5)", framed(f"{agg}(v) over {{w}}", 5, called(fn, "5")), LATE)
    add("fn_movingAverage_interval", f"movingAverage({ALL},'6h')", framed("avg(v) over {w}", 6, called("movingAverage", "'6h'")), LATE)
    add("fn_movingAverage_xff", f"movingAverage({ALL},5,0.6)", framed("avg(v) over {w}", 5, called("movingAverage", "5"), 0.6), LATE)
    add("fn_movingSum_long", f"movingSum({ALL},'300h')", framed("sum(v) over {w}", 300, called("movingSum", "'300h'")), (T1 - 5 * 86400, T1))
    _SQL["fn_movingSum_long"] = _SQL["fn_movingSum_long"].replace(str(LATE[0] - 300 * 3600), str(T1 - 5 * 86400 - 300 * 3600)).replace(f"ts >= {LATE[0]}", f"ts >= {T1 - 5 * 86400}")
    whole = "case when count(v) over {w} = count(*) over {w} then product(v) over {w} end"
    for func, agg in (
        ("average", "avg(v) over {w}"), ("avg", "avg(v) over {w}"), ("avg_zero", "sum(v) over {w} / count(*) over {w}"), ("sum", "sum(v) over {w}"), ("min", "min(v) over {w}"), ("max", "max(v) over {w}"),
        ("multiply", whole), ("range", "max(v) over {w} - min(v) over {w}"), ("stddev", "stddev_pop(v) over {w}"), ("count", "count(v) over {w}"), ("last", "last_value(v) over {w}"), ("median", "median(v) over {w}"),
        ("diff", "2 * first_value(v) over {w} - sum(v) over {w}"),
    ):
        n = 3 if func == "multiply" else 6
        add(f"fn_movingWindow_{func}", f"movingWindow({ALL},{n},'{func}')", framed(agg, n, called("movingWindow", str(n))), LATE)
    _QUERIES["fn_movingWindow"], _SQL["fn_movingWindow"] = _QUERIES["fn_movingWindow_average"], _SQL["fn_movingWindow_average"]
    m = "(partition by name order by ts rows between 5 preceding and current row)"
    add("fn_movingMedian", f"movingMedian({ALL},6)", each(f"case when i >= 5 then median(v) over {m} end", called("movingMedian", "6")))
    s = "(partition by name order by ts rows between 9 preceding and current row)"
    add("fn_stdev", f"stdev({ALL},10,0.5)", each(f"case when v is not null and not (i >= 5 and count(v) over {s} < 5) then stddev_pop(v) over {s} end", called("stdev", "10")))
    pair = """pq as (select a.ts, case when b.v is not null then a.v end as x, case when a.v is not null then b.v end as y from pts a join pts b using (ts) where a.path = 'shop.click.g0' and b.path = 'shop.view.g1'),
pw as (select ts, row_number() over (order by ts) as n, corr(x, y) over w as r, stddev_pop(x) over w as sx, stddev_pop(y) over w as sy from pq window w as (order by ts rows between 23 preceding and current row))"""
    add("fn_pearson", "pearson(shop.click.g0,shop.view.g1,24)", each("case when n >= 24 and sx > 0 and sy > 0 and not isnan(r) then r end", "'pearson(shop.click.g0,shop.view.g1,24)'", "pw", ctes=pair))
    ks = f"""with {_PTS}, xs as (select i, v from pts where path = 'shop.click.g0'), ys as (select i, v from pts where path = 'shop.view.g1'),
x as (select a.i, b.v from xs a join xs b on b.i between a.i - 23 and a.i where a.i >= 24 and b.v is not null), y as (select a.i, b.v from xs a join ys b on b.i between a.i - 23 and a.i where a.i >= 24 and b.v is not null),
nn as (select i, (select count(*) from x where x.i = t.i) as n, (select count(*) from y where y.i = t.i) as m from xs t),
ev as (select i, v from x union all select i, v from y),
df as (select ev.i, ev.v, (select count(*) from x where x.i = ev.i and x.v <= ev.v) / n::double as f, (select count(*) from y where y.i = ev.i and y.v <= ev.v) / m::double as g, n, m from ev join nn using (i) where n > 0 and m > 0),
ds as (select i, max(abs(f - g)) as d, sqrt(any_value(n) * any_value(m) / (any_value(n) + any_value(m))::double) as e from df group by i),
lm as (select i, (e + 0.12 + 0.11 / e) * d as lam from ds),
kv as (select i, case when lam < 0.2 then 1.0 else least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: (case when j % 2 = 1 then 1 else -1 end) * exp(-2 * j * j * lam * lam))))) end as p from lm)
select 'kolmogorovSmirnovTest2(shop.click.g0,shop.view.g1,24)' as name, {T0} + xs.i * 3600 as ts, round(p, 6) + 0.0 as value from xs left join kv using (i)"""
    for fn in ("kolmogorovSmirnovTest2", "ksTest2"):
        add(f"fn_{fn}", f"{fn}(shop.click.g0,shop.view.g1,24)", ks)
    fit = "lf as (select name as lname, regr_slope(v, i) as b, regr_intercept(v, i) as a, count(v) as n from pts group by all)"
    line = ("case when n >= 2 then a + b * i end", "pts join lf on lname = name")
    add("fn_linearRegression", f"linearRegression({ALL})", each(line[0], called("linearRegression"), line[1], ctes=fit))
    add("fn_polyfit", f"polyfit({ALL},1)", each(line[0], called("polyfit", "1"), line[1], ctes=fit))
    # orthogonal polynomials over the places that have a value, one degree after the other
    steps, shown = "", []
    for k in range(4):
        terms = "".join(f" - coalesce(a{k}{j}, 0) * q{j}" for j in range(k))
        carried = "".join(f", q{j}" for j in range(k))
        prev = "xs" if k == 0 else f"o{k - 1}"
        dots = ", ".join([f"sum(pow(i / 720.0, {k}) * q{j}) filter (v is not null) / sum(q{j} * q{j}) filter (v is not null) as a{k}{j}" for j in range(k)] or ["0 as none"])
        steps += f", c{k} as (select name as cn, {dots} from {prev} group by 1), o{k} as (select name, ts, i, v{carried}, pow(i / 720.0, {k}){terms} as q{k} from {prev} join c{k} on cn = name)"
        shown.append(f"b{k} * q{k}")
    coef = ", ".join(f"sum(v * q{k}) filter (v is not null) / sum(q{k} * q{k}) filter (v is not null) as b{k}" for k in range(4))
    cubic = f"""with {_PTS}, xs as (select name, ts, i, v from pts union all select name, {T1} + k * 3600, 720 + k, null from names, (select unnest(range(24)) as k)){steps},
fc as (select name as fn, {coef} from o3 group by 1) select {called("polyfit", "3", "'1d'")} as name, ts, round({" + ".join(shown)}, 6) + 0.0 as value from o3 join fc on fn = name"""
    add("fn_polyfit_cubic", f"polyfit({ALL},3,'1d')", cubic)
    dft = f"""with {_PTS}, fr as (select a.name, a.ts, sum(coalesce(b.v, 0) * cos(2 * pi() * ((a.i * b.i) % 720) / 720)) as re, sum(coalesce(b.v, 0) * sin(2 * pi() * ((a.i * b.i) % 720) / 720)) as im from pts a join pts b on a.name = b.name group by a.name, a.ts)
select 'fft(' || name || ',''abs'')' as name, ts, round(sqrt(re * re + im * im), 6) + 0.0 as value from fr"""
    add("fn_fft", f"fft({ALL},'abs')", dft)
    # the middle frequency is real: its phase is 0 or pi
    both = dft.replace("sin(2 * pi() * ((a.i * b.i) % 720) / 720)", "case when (a.i * b.i) % 360 = 0 then 0 else sin(2 * pi() * ((a.i * b.i) % 720) / 720) end")
    phase = "select 'fft(' || name || ',''phase'')' as name, ts, round(case when im = 0 then case when re < 0 then pi() else 0 end else atan2(-im, re) end, 6) + 0.0 as value from fr"
    add("fn_fft_both", f"fft({ALL})", f"{both} union all {phase}")
    # there and back again gives the values, absent ones as 0
    add("fn_ifft", f"ifft(fft({ALL},'abs'),fft({ALL},'phase'))", each("coalesce(v, 0)", "'ifft(fft(' || name || ',''abs''),fft(' || name || ',''phase''))'"))


# -- buckets ----------------------------------------------------------------------


def _buckets() -> None:
    def tumbling(agg: str, b: int, name: str, trailing: bool = True, lo: int = T0, src_lo: int = T0) -> str:
        hi = -(-(T1 - lo) // b) * b + lo + (b if trailing else 0)
        grid = f"bk as (select name as bname, unnest(range({lo}, {hi}, {b})) as bts from names), sm as (select name as sname, {lo} + (ts - {lo}) // {b} * {b} as sts, {agg} as v from pts group by all)"
        return f"with {points(src_lo, T1)}, {grid} select {name.replace('|| name ||', '|| bname ||')} as name, bts as ts, round(v, 6) + 0.0 as value from bk left join sm on sname = bname and sts = bts"

    add("fn_summarize", f"summarize({ALL},'1d','sum')", tumbling("sum(v)", 86400, called("summarize", "'1d'", "'sum'")))
    for func, agg in (("avg", "avg(v)"), ("max", "max(v)"), ("last", "arg_max(v, ts)"), ("count", "case when count(v) > 0 then count(v) end"), ("median", "median(v)"), ("p90", "quantile_cont(v, 0.9)"), ("range", "max(v) - min(v)"), ("stddev", "stddev_pop(v)")):
        add(f"fn_summarize_{func}", f"summarize({ALL},'6h','{func}')", tumbling(agg, 21600, called("summarize", "'6h'", f"'{func}'")))
    add("fn_summarize_aligned", f"summarize({ALL},'7h','sum',true)", tumbling("sum(v)", 25200, called("summarize", "'7h'", "'sum'", "true"), False))
    # weeks begin on a Monday, as 2024-01-01 was
    add("fn_summarize_week", f"summarize({ALL},'1w','sum')", tumbling("sum(v)", 604800, called("summarize", "'1w'", "'sum'")))
    add("fn_smartSummarize", f"smartSummarize({ALL},'4h','max')", tumbling("max(v)", 14400, called("smartSummarize", "'4h'", "'max'"), False))
    add("fn_smartSummarize_unit", f"smartSummarize({ALL},'1d','sum','months')", tumbling("sum(v)", 86400, called("smartSummarize", "'1d'", "'sum'"), False), LATE)
    for q, width, text, aligned in (("fn_hitcount", 5400, "90min", False), ("fn_hitcount_aligned", 86400, "1d", True)):
        n = -(-(T1 - T0) // width)
        o = T0 if aligned else T1 - n * width
        e = T0 + (T1 - T0) // width * width + width if aligned else T1
        ov = f"least(ts + 3600, b.bts + {width}) - greatest(ts, b.bts)"
        sql = f"""with {_PTS}, b as (select unnest(range({o}, {e}, {width})) as bts),
hc as (select name as hname, b.bts as hts, sum(v * ({ov})) as h from pts join b on ts < b.bts + {width} and ts + 3600 > b.bts where v is not null group by all)
select {called("hitcount", f"'{text}'", *(["true"] if aligned else [])).replace("|| name ||", "|| n.name ||")} as name, b.bts as ts, round(h, 6) + 0.0 as value from names n cross join b left join hc on hname = n.name and hts = b.bts"""
        add(q, f"hitcount({ALL},'{text}'{',true' if aligned else ''})", sql)
    share = "coalesce(avg((v > 150)::int), 0)"
    slo = f"with {_PTS} select {{n}} as name, {T0} + (ts - {T0}) // 86400 * 86400 as ts, round({{e}}, 6) + 0.0 as value from pts group by all"
    add("fn_slo", f"slo({ALL},'1d','above',150)", slo.format(n=called("slo", "'1d'", "'above'", "150"), e=share))
    add("fn_sloErrorBudget", f"sloErrorBudget({ALL},'1d','above',150,0.4)", slo.format(n=called("sloErrorBudget", "'1d'", "'above'", "150", "0.4"), e=f"({share} - 0.4) * 86400"))
    add("fn_consolidateBy", f"consolidateBy({ALL},'max')", each("v", called("consolidateBy", '"max"')))
    for fn in ("setXFilesFactor", "xFilesFactor"):
        # the factor makes buckets absent where fewer values are present
        add(f"fn_{fn}", f"summarize({fn}({ALL},0.5),'1d','sum')", tumbling("case when count(v) / count(*) >= 0.5 then sum(v) end", 86400, called("summarize", "'1d'", "'sum'")))


# -- across series ----------------------------------------------------------------

FOLD_SQL = {
    "sum": "sum(v)", "total": "sum(v)", "avg": "avg(v)", "average": "avg(v)", "avg_zero": "sum(v) / count(*)", "max": "max(v)", "min": "min(v)",
    "last": "arg_max(v, ord)", "current": "arg_max(v, ord)", "first": "max(v) filter (ord = 1)", "range": "max(v) - min(v)", "rangeOf": "max(v) - min(v)", "median": "median(v)",
    "multiply": "case when count(v) = count(*) then product(v) end", "diff": "2 * arg_min(v, ord) - sum(v)", "count": "case when count(v) > 0 then count(v) end", "stddev": "stddev_pop(v)",
}


def folded(expr: str, name: str, group: str = "", where: str = "true", ctes: str = "") -> str:
    return f"with {_PTS}{',' + ctes if ctes else ''} select {name} as name, ts, round({expr}, 6) + 0.0 as value from pts where {where} group by ts{', ' + group if group else ''}"


def _combine() -> None:
    for func, expr in FOLD_SQL.items():
        target = "shop.click.*" if func == "multiply" else ALL
        where = "et = 'click'" if func == "multiply" else "true"
        for fn in (func, func + "Series"):
            add(f"fn_{fn}", f"{fn}({target})", folded(expr, f"'{func}Series({target})'", where=where))
    add("fn_aggregate", f"aggregate({ALL},'sum')", folded("sum(v)", f"'sumSeries({ALL})'"))
    add("fn_aggregate_xff", f"aggregate({ALL},'average',0.6)", folded("case when count(v) / count(*) >= 0.6 then avg(v) end", f"'averageSeries({ALL})'"))
    add("fn_sum_many", "sum(shop.click.*,shop.view.*)", folded("sum(v)", "'sumSeries(shop.click.*,shop.view.*)'", where="et in ('click', 'view')"))
    add("fn_aggregateWithWildcards", f"aggregateWithWildcards({ALL},'max',2)", folded("max(v)", "'shop.' || et", "et"))
    add("fn_sumSeriesWithWildcards", f"sumSeriesWithWildcards({ALL},1)", folded("sum(v)", "'shop.' || gr", "gr"))
    add("fn_averageSeriesWithWildcards", f"averageSeriesWithWildcards({ALL},0,2)", folded("avg(v)", "et", "et"))
    add("fn_multiplySeriesWithWildcards", f"multiplySeriesWithWildcards({ALL},2)", folded(FOLD_SQL["multiply"], "'shop.' || et", "et"))
    add("fn_groupByNode", f"groupByNode({ALL},1,'sum')", folded("sum(v)", "et", "et"))
    add("fn_groupByNode_function", f"groupByNode({ALL},1,'group')", f"with {_PTS} select et as name, ts, round(v, 6) + 0.0 as value from pts")
    add("fn_groupByNodes", f"groupByNodes({ALL},'max',2,0)", folded("max(v)", "gr || '.shop'", "gr"))
    add("fn_groupByTags", f"groupByTags({ALL},'sum','type')", folded("sum(v)", "'sum;type=' || et", "et"))
    add("fn_groupByTags_name", f"groupByTags({ALL},'avg','name','grp')", folded("avg(v)", "path || ';grp=' || gr", "path, gr"))
    add("fn_percentileOfSeries", f"percentileOfSeries({ALL},70)", folded("list_sort(list(v) filter (v is not null))[ceil((count(v) - 1) * 70 / 100.0)::int + 1]", f"'percentileOfSeries({ALL},70)'"))
    add("fn_percentileOfSeries_between", f"percentileOfSeries({ALL},70,true)", folded("quantile_cont(v, 0.7)", f"'percentileOfSeries({ALL},70)'"))
    two = "case when count(v) = count(*) and isfinite(pow(max(v) filter (gr = 'g0'), max(v) filter (gr = 'g1'))) then pow(max(v) filter (gr = 'g0'), max(v) filter (gr = 'g1')) end"
    add("fn_powSeries", "powSeries(scale(shop.click.g0,0.01),scale(shop.click.g1,0.01))", folded(two, "'powSeries(scale(shop.click.g0,0.01),scale(shop.click.g1,0.01))'", where="v is null or true", ctes="").replace("from pts where v is null or true", "from (select ts, gr, v * 0.01 as v from pts where et = 'click' and gr <> 'g2')"))
    add("fn_countValues", f"countValues(round(scale({ALL},0.005)))", f"""with {_PTS}, q as (select ts, (round_even(v * 0.005, 0))::bigint as k from pts where v is not null), ks as (select distinct k from q), tt as (select distinct ts from pts), ct as (select k, ts, count(*) as c from q group by all)
select ks.k::varchar as name, tt.ts, round(coalesce(c, 0), 6) + 0.0 as value from ks cross join tt left join ct on ct.k = ks.k and ct.ts = tt.ts""")
    add("fn_weightedAverage", "weightedAverage(shop.click.*,shop.view.*,2)", f"""with {_PTS}, a as (select gr, ts, v from pts where et = 'click'), b as (select gr, ts, v from pts where et = 'view')
select 'weightedAverage(shop.click.*,shop.view.*,2)' as name, ts, round(case when sum(b.v) <> 0 then sum(a.v * b.v) / sum(b.v) end, 6) + 0.0 as value from a full join b using (gr, ts) group by ts""")
    over = f"with {_PTS}, d as (select ts as dts, v as d from pts where path = 'shop.view.g0')"
    add("fn_divideSeries", f"divideSeries({ALL},shop.view.g0)", f"{over} select {called('divideSeries', 'shop.view.g0')} as name, ts, round(case when d <> 0 then v / d end, 6) + 0.0 as value from pts left join d on dts = ts")
    add("fn_divideSeries_one", "divideSeries(shop.view.{g0,g1})", f"with {_PTS}, d as (select ts as dts, v as d from pts where path = 'shop.view.g1') select 'divideSeries(shop.view.{{g0,g1}})' as name, ts, round(case when d <> 0 then v / d end, 6) + 0.0 as value from pts left join d on dts = ts where path = 'shop.view.g0'")
    for fn in ("asPercent", "pct"):
        add(f"fn_{fn}", f"{fn}({ALL})", each("case when sum(v) over (partition by ts) <> 0 then 100 * v / sum(v) over (partition by ts) end", called("asPercent")))
    add("fn_asPercent_constant", f"asPercent({ALL},1500)", each("100 * v / 1500", called("asPercent", "1500")))
    add("fn_asPercent_series", f"asPercent({ALL},shop.view.g0)", f"{over} select {called('asPercent', 'shop.view.g0')} as name, ts, round(case when d <> 0 then 100 * v / d end, 6) + 0.0 as value from pts left join d on dts = ts")
    add("fn_asPercent_nodes", f"asPercent({ALL},None,1)", each("case when sum(v) over (partition by ts, et) <> 0 then 100 * v / sum(v) over (partition by ts, et) end", called("asPercent", "None")))
    add("fn_asPercent_matched", "asPercent(shop.click.*,shop.view.*,2)", f"""with {_PTS} select 'asPercent(' || a.name || ',' || b.name || ')' as name, a.ts, round(case when b.v <> 0 then 100 * a.v / b.v end, 6) + 0.0 as value
from pts a join pts b on a.gr = b.gr and a.ts = b.ts where a.et = 'click' and b.et = 'view'""")
    add("fn_asPercent_missing", "asPercent(shop.click.{g0,g1},shop.view.{g1,g2},2)", f"""with {_PTS}, a as (select * from pts where et = 'click' and gr <> 'g2'), b as (select * from pts where et = 'view' and gr <> 'g0')
select 'asPercent(' || coalesce(a.name, 'MISSING') || ',' || coalesce(b.name, 'MISSING') || ')' as name, ts, round(case when b.v <> 0 then 100 * a.v / b.v end, 6) + 0.0 as value from a full join b using (gr, ts)""")
    pair = lambda e, n: f"with {_PTS} select {n} as name, a.ts, round({e}, 6) + 0.0 as value from pts a join pts b on a.gr = b.gr and a.ts = b.ts where a.et = 'click' and b.et = 'view'"
    add("fn_aggregateSeriesLists", "aggregateSeriesLists(shop.click.*,shop.view.*,'max')", pair("greatest(a.v, b.v)", "'maxSeries(' || a.name || ',' || b.name || ')'"))
    for fn, e in (("divideSeriesLists", "case when b.v <> 0 then a.v / b.v end"), ("diffSeriesLists", "a.v - b.v"), ("multiplySeriesLists", "a.v * b.v"), ("sumSeriesLists", "a.v + b.v")):
        add(f"fn_{fn}", f"{fn}(shop.click.*,shop.view.*)", pair(e, f"'{fn.removesuffix('Lists')}(' || a.name || ',' || b.name || ')'"))
    add("fn_powSeriesLists", "powSeriesLists(scale(shop.click.*,0.01),scale(shop.view.*,0.01))", pair("pow(a.v * 0.01, b.v * 0.01)", "'powSeries(scale(' || a.name || ',0.01),scale(' || b.name || ',0.01))'"))
    add("fn_sumSeriesLists_default", "sumSeriesLists(shop.click.*,shop.view.*,0)", pair("case when a.v is not null or b.v is not null then coalesce(a.v, 0) + coalesce(b.v, 0) end", "'sumSeries(' || a.name || ',' || b.name || ')'"))
    heat = f"""with {_PTS}, f as (select * from pts where et = 'view'), al as (select ts from f group by ts having count(v) = 3 order by ts limit 5),
sm as (select name, ord, sum(v) as s from f join al using (ts) group by all), rk as (select n.name, row_number() over (order by s asc nulls first, n.ord) as k from names n left join sm using (name) where n.et = 'view'),
h as (select f.name, f.ts, k, f.v - lag(f.v) over (partition by f.ts order by k) as d, lag(f.name) over (partition by f.ts order by k) as p from f join rk using (name))
select 'heatMap(' || name || ',' || p || ')' as name, ts, round(d, 6) + 0.0 as value from h where k > 1"""
    add("fn_heatMap", "heatMap(shop.view.*)", heat)
    for fn in ("reduceSeries", "reduce"):
        add(f"fn_{fn}", f"{fn}({ALL},'asPercent',1,'click','view')", f"with {_PTS} select 'shop.reduce.asPercent.' || a.gr as name, a.ts, round(case when b.v <> 0 then 100 * a.v / b.v end, 6) + 0.0 as value from pts a join pts b on a.gr = b.gr and a.ts = b.ts where a.et = 'click' and b.et = 'view'")
    for fn in ("mapSeries", "map"):
        add(f"fn_{fn}", f"{fn}({ALL},2)", f"with {_PTS}, o as (select name, row_number() over (order by gr, ord)::int as ord from names) select p.name, p.ts, o.ord, round(v, 6) + 0.0 as value from pts p join o using (name)", order=True)


# -- which series, in which order -------------------------------------------------


def kept(where: str, ctes: str = "", name: str = "name") -> str:
    return f"with {_PTS}{',' + ctes if ctes else ''} select {name} as name, ts, round(v, 6) + 0.0 as value from pts where {where}"


def having(expr: str, test: str) -> str:
    return kept("name in (select name from hv)", f"hv as (select name from pts group by name having ({expr}) {test})")


def _filters() -> None:
    add("fn_filterSeries", f"filterSeries({ALL},'max','>',440)", having("max(v)", "> 440"))
    for what, expr, x in (("average", "avg(v)", 77), ("current", "arg_max(v, ts)", 45), ("maximum", "coalesce(max(v), '-infinity'::double)", 440), ("minimum", "coalesce(min(v), 'infinity'::double)", 0.2)):
        add(f"fn_{what}Above", f"{what}Above({ALL},{x})", having(expr, f"> {x}"))
        add(f"fn_{what}Below", f"{what}Below({ALL},{x})", having(expr, f"<= {x}"))
    add("fn_removeEmptySeries", f"removeEmptySeries({ALL},0.5)", having("count(v) / count(*)", ">= 0.5 and count(v) > 0"))
    add("fn_removeZeroSeries", f"removeZeroSeries({ALL})", having("count(v) filter (v <> 0)", "> 0"))
    add("fn_removeBelowValue", f"removeBelowValue({ALL},100)", each("case when v >= 100 then v end", called("removeBelowValue", "100")))
    add("fn_removeAboveValue", f"removeAboveValue({ALL},100)", each("case when v <= 100 then v end", called("removeAboveValue", "100")))
    q = "pc as (select name as pname, quantile_cont(v, 0.3) as t from pts group by all)"
    for fn, op in (("removeBelowPercentile", ">="), ("removeAbovePercentile", "<=")):
        add(f"fn_{fn}", f"{fn}({ALL},30)", each(f"case when v {op} t then v end", called(fn, "30"), "pts join pc on pname = name", ctes=q))
    rank = "list_sort(list({c}) filter ({c} is not null))[ceil((count({c}) - 1) * {p} / 100.0)::int + 1]"
    band = f"bd as (select ts as bts, {rank.format(c='v', p=5)} as lo, {rank.format(c='v', p=95)} as hi from pts group by all)"
    add("fn_removeBetweenPercentile", f"removeBetweenPercentile({ALL},95)", kept("name in (select name from pts join bd on bts = ts where v < lo or v > hi)", band))
    mean = f"mn as (select name, avg(v) as m from pts group by all), bd as (select {rank.format(c='m', p=20)} as lo, {rank.format(c='m', p=80)} as hi from mn)"
    add("fn_averageOutsidePercentile", f"averageOutsidePercentile({ALL},80)", kept("name in (select name from mn, bd where not (m > lo and m < hi))", mean))
    for fn, test in (("tukeyAbove", "v > q3 + 1.5 * (q3 - q1)"), ("tukeyBelow", "v < q1 - 0.2 * (q3 - q1)")):
        basis = "1.5" if fn == "tukeyAbove" else "0.2"
        sql = f"so as (select list_sort(list(v)) as l from pts where v is not null), fe as (select l[floor(0.25 * len(l))::int + 1] as q1, l[floor(0.75 * len(l))::int + 1] as q3 from so), tk as (select name, ord, count(*) as c from pts, fe where {test} group by all order by c desc, ord limit 3)"
        add(f"fn_{fn}", f"{fn}({ALL},{basis},3)", kept("name in (select name from tk)", sql))
    add("fn_grep", f"grep({ALL},'view|g1')", kept("regexp_matches(name, 'view|g1')"))
    add("fn_exclude", f"exclude({ALL},'view|g1')", kept("not regexp_matches(name, 'view|g1')"))
    add("fn_unique", "unique(shop.view.*,shop.*.g1)", kept("et = 'view' or gr = 'g1'"))
    add("fn_fallbackSeries", "fallbackSeries(nothing.*,shop.view.*)", kept("et = 'view'"))
    add("fn_fallbackSeries_first", "fallbackSeries(shop.click.*,shop.view.*)", kept("et = 'click'"))
    add("fn_group", "group(shop.view.*,shop.click.g1)", kept("et = 'view' or path = 'shop.click.g1'"))
    for how, where in (("AND", "et = 'view' and gr = 'g1'"), ("OR", "et = 'view' or gr = 'g1'"), ("XOR", "(et = 'view') <> (gr = 'g1')"), ("SUB", "et = 'view' and gr <> 'g1'")):
        add(f"fn_join_{how.lower()}", f"join(shop.view.*,shop.*.g1,'{how}')", kept(where))
    _QUERIES["fn_join"], _SQL["fn_join"] = _QUERIES["fn_join_and"], _SQL["fn_join_and"]


def ranked(expr: str, direction: str, n: int | None = None) -> str:
    top = f" where ord <= {n}" if n else ""
    return f"with {_PTS}, k as (select name, ord as o, {expr} as k from pts group by all), r as (select name, row_number() over (order by k {direction}, o)::int as ord from k{' where k is not null' if n else ''}) select p.name, p.ts, r.ord, round(v, 6) + 0.0 as value from pts p join (select * from r{top}) r using (name)"


def _sorting() -> None:
    add("fn_sortBy", f"sortBy({ALL},'max',true)", ranked("max(v)", "desc nulls last"), order=True)
    add("fn_sortByMaxima", f"sortByMaxima({ALL})", ranked("max(v)", "desc nulls last"), order=True)
    add("fn_sortByMinima", f"sortByMinima({ALL})", ranked("min(v)", "asc nulls first"), order=True)
    add("fn_sortByTotal", f"sortByTotal({ALL})", ranked("round(sum(v), 6)", "desc nulls last"), order=True)
    add("fn_sortByName", f"sortByName({ALL},false,true)", ranked("name", "desc"), order=True)
    add("fn_sortByName_natural", f"sortByName({ALL},true)", ranked("name", "asc"), order=True)
    aggs = {"": "avg(v)", "Average": "avg(v)", "Current": "arg_max(v, ts)", "Max": "max(v)", "Min": "min(v)"}
    for word, way in (("highest", "desc"), ("lowest", "asc")):
        for what, expr in aggs.items():
            add(f"fn_{word}{what}", f"{word}{what}({ALL},4)", ranked(expr, way, 4), order=True)
    add("fn_mostDeviant", f"mostDeviant({ALL},4)", ranked("round(var_pop(v), 6)", "desc nulls last", 4), order=True)
    cor = f"""with {_PTS}, ref as (select ts, v as y from pts where path = 'shop.click.g0'), c as (select name, ord as o, abs(corr(v, y)) as k from pts join ref using (ts) where v is not null and y is not null group by all),
r as (select name, row_number() over (order by k desc, o)::int as ord from c where k is not null and not isnan(k)) select p.name, p.ts, r.ord, round(v, 6) + 0.0 as value from pts p join r using (name) where r.ord <= 3"""
    add("fn_pearsonClosest", f"pearsonClosest(shop.click.g0,{ALL},3)", cor, order=True)
    add("fn_limit", f"limit({ALL},4)", f"with {_PTS} select name, ts, ord, round(v, 6) + 0.0 as value from pts where ord <= 4", order=True)


# -- other periods ----------------------------------------------------------------


def _shifts() -> None:
    day = 86400
    past = lambda off: f"with {points(LATE[0] - off, T1 - off)}"
    add("fn_timeShift", f"timeShift({ALL},'1d')", f"{past(day)} select 'timeShift(' || name || ',''-86400'',false)' as name, ts + 86400 as ts, round(v, 6) + 0.0 as value from pts", LATE)
    stack = " union all ".join(f"select * from ({past(day * i)} select 'timeShift(' || name || ',''1d'',{i})' as name, ts + {day * i} as ts, round(v, 6) + 0.0 as value from pts)" for i in range(3))
    add("fn_timeStack", f"timeStack({ALL},'1d',0,3)", stack, LATE)
    copies = " union all ".join(f"select name, ts + {day * i} as ts, v from ({past(day * i)} select name, ts, v from pts)" for i in (1, 2, 3))
    base = f"with {points(*LATE)}, past as ({copies}), md as (select name as mname, ts as mts, median(v) as m from past group by all), bl as (select name, ts, v, m from pts left join md on mname = name and mts = ts), ok as (select name from bl group by name having avg(m) >= 0)"
    add("fn_baseline", f"baseline({ALL},'1d',1,4)", f"{base} select {called('baseline')} as name, ts, round(m, 6) + 0.0 as value from bl where name in (select name from ok)", LATE)
    add("fn_baselineAberration", f"baselineAberration({ALL},'1d',1,4)", f"{base} select {called('baselineAberration')} as name, ts, round(case when m <> 0 then v / m end, 6) + 0.0 as value from bl where name in (select name from ok)", LATE)
    add("fn_timeShiftByMetric", "timeShiftByMetric(aliasSub(shop.view.*,'shop.view.g([0-9]).*','app.\\1_0'),aliasSub(shop.click.*,'shop.click.g([0-9]).*','mark.\\1_0'),1)", f"""with {_PTS}, mk as (select right(gr, 1)::int as major, max(ts) as seen from pts where et = 'click' and v is not null group by all), tp as (select arg_max(seen, major) as top from mk)
select 'timeShiftByMetric(app.' || right(gr, 1) || '_0)' as name, ts + top - seen as ts, round(v, 6) + 0.0 as value from pts join mk on major = right(gr, 1)::int, tp where et = 'view'""")


# -- names ------------------------------------------------------------------------


def _naming() -> None:
    def named(expr: str, where: str = "true") -> str:
        return f"with {_PTS} select {expr} as name, ts, round(v, 6) + 0.0 as value from pts where {where}"

    add("fn_alias", "alias(shop.view.*,'views')", named("'views'", "et = 'view'"))
    add("fn_alias_format", f"alias({ALL},'${{type}}-${{grp}}')", named("et || '-' || gr"))
    add("fn_aliasByNode", f"aliasByNode({ALL},1,-1)", named("et || '.' || gr"))
    add("fn_aliasByNode_nested", f"aliasByNode(scale({ALL},1),1)", named("et"))
    add("fn_aliasByTags", f"aliasByTags({ALL},'grp','type')", named("gr || '.' || et"))
    add("fn_aliasByMetric", f"aliasByMetric({ALL})", named("gr"))
    add("fn_aliasSub", f"aliasSub({ALL},'shop.([a-z]+).g([0-9]).*','\\2-\\1')", named("right(gr, 1) || '-' || et"))
    last = f"with {_PTS}, l as (select gr as lgr, arg_max(v, ts) as last from pts where et = 'click' group by all)"
    add("fn_aliasQuery", "aliasQuery(shop.view.*,'shop.view.(g[0-9]).*','shop.click.\\1','clicks %d')", f"{last} select 'clicks ' || trunc(last)::bigint as name, ts, round(v, 6) + 0.0 as value from pts join l on lgr = gr where et = 'view'")
    add("fn_aliasByBase64", "aliasByBase64(alias(shop.view.*,'dmlld3M='))", named("'views'", "et = 'view'"))
    table = lambda spark: spark.createDataFrame([("g0", "zero"), ("g1", "one")], "key string, value string")
    words = "case gr when 'g0' then 'zero' when 'g1' then 'one' else {} end"
    add("fn_aliasByRedis", f"aliasByRedis({ALL},'groups')", named(words.format("name")), lookups={"groups": table})
    add("fn_aliasByRedis_path", f"aliasByRedis({ALL},'groups',true)", named("case gr when 'g0' then 'shop.' || et || '.zero' when 'g1' then 'shop.' || et || '.one' else name end"), lookups={"groups": table})
    add("fn_aliasByPostgres", f"aliasByPostgres({ALL},'groups',2)", named(words.format("name")), lookups={"groups": table})
    add("fn_substr", f"substr({ALL},1,3)", named("et || '.' || gr"))
    add("fn_substr_negative", f"substr({ALL},-2,-1)", named("et"))
    for fn in ("lower", "toLowerCase"):
        add(f"fn_{fn}", f"{fn}(alias({ALL},'VIEWS ÉTÉ'))", named("'views été'"))
    for fn in ("upper", "toUpperCase"):
        add(f"fn_{fn}", f"{fn}({ALL},0,-1)", named("upper(name[1]) || name[2:-2] || upper(name[-1])"))
    legend = f"with {_PTS}, s as (select name as sname, max(v) as x, arg_max(v, ts) as c from pts group by all)"
    add("fn_legendValue", f"legendValue({ALL},'max','last')", f"{legend} select name || ' (max: ' || printf('%.6f', x) || ') (last: ' || printf('%.6f', c) || ')' as name, ts, round(v, 6) + 0.0 as value from pts join s on sname = name")
    cacti = f"with {_PTS}, s as (select name as sname, max(v) as x, min(v) as n, arg_max(v, ts) as c from pts group by all)"
    cell = "rpad(printf('%.2f', {}), 12, ' ')"
    add("fn_cactiStyle", f"cactiStyle({ALL})", f"{cacti} select rtrim(name || ' Current:' || {cell.format('c')} || ' Max:' || {cell.format('x')} || ' Min:' || {cell.format('n')}) as name, ts, round(v, 6) + 0.0 as value from pts join s on sname = name")
    agg = f"with {_PTS}, s as (select name as sname, max(v) as k from pts group by all)"
    add("fn_aggregateLine", f"alias(aggregateLine({ALL},'max'),'line')", f"{agg} select 'line' as name, unnest([{T0}, {T1}])::bigint as ts, round(k, 6) + 0.0 as value from s")
    add("fn_aggregateLine_grid", f"alias(aggregateLine({ALL},'max',true),'line')", f"{agg} select 'line' as name, ts, round(k, 6) + 0.0 as value from pts join s on sname = name")
    pc = f"with {_PTS}, s as (select name as sname, quantile_cont(v, 0.75) as k from pts group by all)"
    add("fn_nPercentile", f"nPercentile({ALL},75)", f"{pc} select {called('nPercentile', '75')} as name, ts, round(k, 6) + 0.0 as value from pts join s on sname = name")
    add("fn_seriesByTag", "seriesByTag('type=view','grp=~g[01]')", named("name", "et = 'view' and gr in ('g0', 'g1')"))
    add("fn_seriesByTag_not", "seriesByTag('type!=view','grp!=~g[01]','name=~shop')", named("name", "et <> 'view' and gr not in ('g0', 'g1')"))
    add("fn_applyByNode", f"applyByNode({ALL},1,'sumSeries(%.*)','%.total')", folded("sum(v)", "'shop.' || et || '.total'", "et"))
    hot = "(select et from pts where gr = 'g1' group by et having max(v) > 400)"
    for fn in ("useSeriesAbove", "aboveSeries"):
        add(f"fn_{fn}", f"{fn}(shop.*.g1,400,'g1;.*','g2')", kept(f"gr = 'g2' and et in {hot}"))


# -- made from nothing, or drawn --------------------------------------------------


def _made() -> None:
    ts = f"(select unnest(range({T0}, {T1}, 600)) as ts)"
    add("fn_constantLine", "constantLine(42.5)", f"select '42.5' as name, unnest([{T0}, {T1}])::bigint as ts, 42.5::double as value")
    add("lang_constant", "7", f"select '7' as name, {T0}::bigint as ts, 7.0::double as value")
    add("fn_identity", "identity('now')", f"select 'identity(now)' as name, ts, ts::double as value from (select unnest(range({T0}, {T1}, 60)) as ts)")
    for fn in ("time", "timeFunction"):
        add(f"fn_{fn}", f"{fn}('clock',600)", f"select 'clock' as name, ts, ts::double as value from {ts}")
    for fn in ("sin", "sinFunction"):
        add(f"fn_{fn}", f"{fn}('wave',2,600)", f"select 'wave' as name, ts, round(2 * sin(ts), 6) + 0.0 as value from {ts}")
    for fn in ("randomWalk", "randomWalkFunction"):
        add(f"fn_{fn}", f"{fn}('walk',600)", None)
    add("fn_verticalLine", f"verticalLine('{T0 + 86400}','mark')", f"select 'mark' as name, unnest([{T0 + 86400}, {T0 + 86401}])::bigint as ts, 1.0::double as value")
    add("fn_threshold", "threshold(42.5,'limit','red')", f"select 'limit' as name, unnest([{T0}, {T1}])::bigint as ts, 42.5::double as value")
    area = f"with {_PTS}, lo as (select ts as lts, v as l from pts where path = 'shop.view.g0') select 'areaBetween(shop.view.{{g0,g1}})' as name, ts, round(case when gr = 'g0' then v else v - l end, 6) + 0.0 as value from pts left join lo on lts = ts where et = 'view' and gr <> 'g2'"
    add("fn_areaBetween", "areaBetween(shop.view.{g0,g1})", area)
    plain = {"color": ("'red'", "name"), "alpha": ("0.5", "name"), "dashed": ("3", called("dashed", "3")), "drawAsInfinite": ("", called("drawAsInfinite")), "secondYAxis": ("", called("secondYAxis")), "lineWidth": ("2", "name"), "stacked": ("'s'", "name")}
    for fn, (arg, name) in plain.items():
        target = f"{fn}({ALL},{arg})" if arg else f"{fn}({ALL})"
        _graph(fn, target, name)


_OPTION = {"color": ("color", "red"), "alpha": ("alpha", "0.5"), "dashed": ("dashed", "3"), "drawAsInfinite": ("drawAsInfinite", "true"), "secondYAxis": ("secondYAxis", "true"), "lineWidth": ("lineWidth", "2"), "stacked": ("stackName", "s")}


def _graph(fn: str, target: str, name: str) -> None:
    """Graph options are columns of the series; the query shows the option beside the name."""
    key, value = _OPTION[fn]

    def query(spark: SparkSession, d: str) -> DataFrame:
        from ..plans.engine import Engine
        from ..sources import tables

        f = Engine(spark, tables.events(spark, d)).frame(target, *FULL, now=T1)
        return f.series.select("name", F.try_element_at("opts", F.lit(key)).alias("option"))

    _QUERIES[f"fn_{fn}"] = query
    _SQL[f"fn_{fn}"] = f"with {_PTS} select {name} as name, '{value}' as option from names"


for _part in (_scalar, _sequential, _moving, _buckets, _combine, _filters, _sorting, _shifts, _naming, _made):
    _part()


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
