"""Queries beside single functions: the flagship, sources, metadata, output, display, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import NAME, T0, T1, digits, points

FLAGSHIP = "sortByTotal(groupByNode(summarize(shop.*.*,'1d','sum'),1,'sum'))"
SHIP0, SHIP1 = 788918400, 1009843200  # 1995-01-01 and 2002-01-01


def _engine(spark: SparkSession, source):
    from ..plans.engine import Engine

    return Engine(spark, source)


def _events(spark: SparkSession, d: str):
    from ..sources import tables

    return tables.events(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, _events(spark, d)).render(FLAGSHIP, T0, T1, now=T1).select("name", "ts", "ord", digits())


def shipments_daily(spark: SparkSession, d: str) -> DataFrame:
    """Quantities per flag, a moving week, over all line items."""
    from ..sources import tables

    out = _engine(spark, tables.shipments(spark, d)).render("groupByNode(ship.*.*.*,1,'sum')", SHIP0, SHIP1, now=SHIP1)
    return out.select("name", "ts", digits())


def orders_share(spark: SparkSession, d: str) -> DataFrame:
    """Each priority's share of the daily total price."""
    from ..sources import tables

    out = _engine(spark, tables.orders(spark, d)).render("asPercent(summarize(orders.*.total,'30d','sum',true))", SHIP0, SHIP1, now=SHIP1)
    return out.select(F.regexp_extract("name", r"orders\.([^.]+)", 1).alias("name"), "ts", digits())


#: Calls over all stored series, whose steps differ, by the query's name.
STORED = {
    "source_responses": "groupByNodes(*.*.*.*.*,'max',1,3,4)",
    "mixed_sum": "sum(*.*.*.cpu.user_pct)",
    "mixed_groupByNode": "groupByNode(*.*.*.*.*,4,'sum')",
    "mixed_divideSeries": "divideSeries(*.*.*.cpu.user_pct,max(*.*.*.queue.depth))",
    "mixed_asPercent": "asPercent(*.*.*.requests.count)",
    "mixed_lists": "aggregateSeriesLists(limit(*.*.*.cpu.user_pct,3),limit(*.*.*.disk.used_pct,3),'max')",
    "mixed_summarize": "summarize(*.*.*.requests.count,'6h','max',true)",
    "mixed_consolidate": "consolidateBy(*.*.*.limit.max_open,'max')",
}


def significant(c: str = "value"):
    """Six decimals of usual values, twelve digits of large ones; none lies on a half of the last one."""
    x = F.col(c) * F.lit(1 + 3.1e-13)
    return (F.when(F.abs(x) < 1e6, F.round(x, 6)).otherwise(F.format_string("%.11e", x).try_cast("double")) + F.lit(0.0)).alias(c)


def _stored(target: str, alone: bool = False):
    """A call over the whole time of the stored responses, under the catalogue or `alone`; the range is one small question to the driver."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        from ..session import read
        from ..sources import tables
        from ..sources.auto import open_source

        lo, hi = read(spark, d, "fetch_responses").where("step > 0 and stop > start").agg(F.min("start"), F.max("stop")).first()
        lo, hi = (lo // 3600 * 3600, hi) if lo is not None else (0, 3600)
        source = open_source(read(spark, d, "fetch_responses")) if alone else tables.fetched(spark, d)
        return _engine(spark, source).render(target, lo, hi, now=hi).select("name", "ts", significant())

    return query


def replicas_merged(spark: SparkSession, d: str) -> DataFrame:
    """Values of each series from all servers: the finest step of each range whole, gaps of the longest answer filled from others."""
    from ..session import read
    from ..sources.responses import answers, merge_replicas

    return merge_replicas(answers(read(spark, d, "server_responses"))).select("name", "ts", "step", F.col("v").alias("value"))


def display_points(spark: SparkSession, d: str) -> DataFrame:
    """At most a hundred points per series, merged by each series' own function."""
    out = _engine(spark, _events(spark, d)).render("consolidateBy(shop.*.*,'max')", T0, T1, now=T1, max_data_points=100)
    return out.select("name", "ts", digits())


def many_targets(spark: SparkSession, d: str) -> DataFrame:
    """Two targets in one request; the pattern they share is read once."""
    out = _engine(spark, _events(spark, d)).render(["sum(shop.view.*)", "max(shop.view.*)"], T0, T1, now=T1)
    return out.select("name", "ts", "ord", digits())


def _sink(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        from .. import sinks

        f = _engine(spark, _events(spark, d)).frame("summarize(shop.view.*,'1d','count')", T0, T1, now=T1)
        return {"json": sinks.to_json, "csv": sinks.to_csv, "raw": sinks.to_raw}[kind](f)

    return query


def _meta(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        from ..plans.engine import function_catalogue
        from ..sources import metadata as m
        from ..sources import tables

        s = _events(spark, d)
        return {
            "find": lambda: m.find(s, "shop.*"),
            "find_leaf": lambda: m.find(s, "shop.{view,click}.*"),
            "expand": lambda: m.expand(s, ["shop.view.*", "shop.*"]),
            "expand_grouped": lambda: m.expand(s, ["shop.view.*", "shop.*.g1"], True, True),
            "tag_names": lambda: m.tag_names(s, "", 2),
            "tag_values": lambda: m.tag_values(s, "type"),
            "info": lambda: m.info(s, "shop.view.*"),
            "info_stored": lambda: m.info(tables.fetched(spark, d), "*.web.*.*.*").drop("xff").fillna("none", ["cons_func"]),
            "find_tree": lambda: m.find_tree(s, "shop.*"),
            "complete": lambda: m.complete(s, "shop.*"),
            "functions": lambda: function_catalogue(spark).select("name", "group", "signature"),
        }[kind]()

    return query


def stream_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The buckets that a stream of events would give, over the table at rest."""
    from ..session import read
    from ..streaming.summaries import summarize_stream

    df = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return summarize_stream(df, "1 hour", "sum", "event_type", "ts", "value").select("name", "ts", digits())


def _plain(target, **options):
    """A request over the events, with the place of each series."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return _engine(spark, _events(spark, d)).render(target, T0, T1, now=T1, **options).select("name", "ts", "ord", digits())

    return query


def query_range(spark: SparkSession, d: str) -> DataFrame:
    """Thirty days in two hundred points at most: six hours a point."""
    return _engine(spark, _events(spark, d)).query_range("shop.*.*", T0, T1, now=T1, most=200).select("name", "ts", digits())


_LANG = {
    "source_query_range": query_range,
    "source_auto": lambda spark, d: _stored("groupByNodes(*.*.*.*.*,'max',3,4)", alone=True)(spark, d),
    "lang_matches": _plain("shop.{view,click}.{g2,g0,g1}"),
    "lang_tolerant": _plain(["sum(shop.view.*)", "nosuch(shop.view.*)", "scale(shop.view.*", "max(shop.view.*)"], tolerant=True),
    "lang_fallback": _plain("fallbackSeries(nosuch(shop.click.*),shop.view.*)"),
    "fn_reduceSeries_from_end": lambda spark, d: _plain("aliasByNode(reduceSeries(shop.*.*,'asPercent',-2,'click','view'),3)")(spark, d).drop("ord"),
    "fn_reduceSeries_any": lambda spark, d: _plain("reduceSeries(shop.*.*,'absolute',1,'view')")(spark, d).drop("ord"),
}
_METAS = ("info_stored", "find_tree", "complete", "find", "find_leaf", "expand", "expand_grouped", "tag_names", "tag_values", "info", "functions")


def queries() -> dict:
    return (
        {"flagship": flagship, "source_shipments": shipments_daily, "source_orders": orders_share, "source_replicas": replicas_merged, "display_points": display_points, "lang_targets": many_targets, "stream_summarize": stream_buckets}
        | {name: _stored(target) for name, target in STORED.items()}
        | {f"sink_{k}": _sink(k) for k in ("json", "csv", "raw")}
        | {f"meta_{k}": _meta(k) for k in _METAS}
        | _LANG
    )


_PTS = points()
_DAYS = f"dd as (select name, ord, et, unnest(range({T0}, {T1 + 86400}, 86400)) as ts from names), sm as (select name, {T0} + (ts - {T0}) // 86400 * 86400 as ts, {{agg}} as v from pts group by all)"

_FLAGSHIP = f"""with {_PTS}, {_DAYS.format(agg="sum(v)")}, g as (select et as name, dd.ts, sum(v) as v from dd left join sm using (name, ts) group by et, dd.ts),
r as (select name, row_number() over (order by round(sum(v), 6) desc nulls last, name)::int as ord from g group by name)
select name, ts, ord, round(v, 6) + 0.0 as value from g join r using (name)"""

_SHIP = f"""with b as (select l_returnflag as f, l_returnflag || '.' || l_linestatus || l_linenumber as s, epoch(date_trunc('day', l_shipdate))::bigint as ts, sum(l_quantity) as v from lineitem where epoch(l_shipdate) >= {SHIP0} and epoch(l_shipdate) < {SHIP1} group by all),
g as (select f, t.ts from (select distinct f from b) cross join (select unnest(range({SHIP0}, {SHIP1}, 86400)) as ts) t), s as (select f, ts, sum(v) as v from b group by all)
select g.f as name, g.ts, round(s.v, 6) + 0.0 as value from g left join s using (f, ts)"""

_ORDERS = f"""with b as (select regexp_replace(o_orderpriority, '\\W+', '_', 'g') as p, {SHIP0} + (epoch(date_trunc('day', o_orderdate))::bigint - {SHIP0}) // 2592000 * 2592000 as ts, sum(o_totalprice) as v from orders where epoch(o_orderdate) >= {SHIP0} and epoch(o_orderdate) < {SHIP1} group by all),
g as (select p, t.ts from (select distinct p from b) cross join (select unnest(range({SHIP0}, {SHIP0} + ({SHIP1 - SHIP0} + 2591999) // 2592000 * 2592000, 2592000)) as ts) t)
select p as name, g.ts, round(case when sum(v) over (partition by g.ts) <> 0 then 100 * v / sum(v) over (partition by g.ts) end, 6) + 0.0 as value from g left join b using (p, ts)"""

_TRIM = "' ' || chr(9) || chr(10) || chr(13)"


def _merged(table: str) -> str:
    """`flat` and `merged`: the answers of a table and their values, each range at its finest step."""
    from .preparation import CANON

    return f"""flat as (select {CANON.format(n="name")} as name, start // 3600 as h0, stop // 3600 as h1, start, stop, step, least(len(vals), ceil((stop - start) / step))::bigint as l, start + (u.i - 1) * step as t, u.v
  from {table} r, lateral (select unnest(range(1, len(r.vals) + 1)) as i, unnest(r.vals) as v) u
  where name is not null and step > 0 and start + (u.i - 1) * step < stop and u.v is not null and not isnan(u.v)),
fine as (select name, h0, h1, min(step) as finest from flat group by all),
span as (select name, h0, h1, finest, min(start) as lo, max(stop) as hi from flat join fine using (name, h0, h1) where step = finest group by all),
merged as (select name, t - t % step as ts, min(step) as step, max_by(v, (-step, l, v)) as v from flat join span using (name, h0, h1)
  where step = finest or t - t % step + step <= lo or t - t % step >= hi group by 1, 2)"""


_CONS = "case cf when 'sum' then sum(v) when 'max' then max(v) when 'last' then arg_max(v, t) when 'min' then min(v) else avg(v) end"


def _series(name: str, nodes: str) -> str:
    """`{name}`: the stored series that a pattern of five nodes selects, on their common step: name, path, ord, xff, step, ts, v."""
    want = " and ".join(["len(string_split(split_part(name, ';', 1), '.')) = 5", *(f"string_split(split_part(name, ';', 1), '.')[{i + 1}] = '{n}'" for i, n in enumerate(nodes.split(".")) if n != "*")])
    globs = ", ".join(f"string_split(path, '.')[{i + 1}]" for i, n in enumerate(nodes.split(".")) if n == "*")
    return f"""{name}_s as (select name, split_part(name, ';', 1) as path, step as own, coalesce(cons_func, 'average') as cf, coalesce(case when isnan(xff) then 0 else xff end, 0) as xff,
  ceil(lo / step)::bigint * step as g0, ceil(hi / step)::bigint * step as g1 from series, rng where start < hi and stop > lo and {want}),
{name}_n as (select *, row_number() over (order by {globs}, name)::int as ord, (select list_reduce(list(distinct own), lambda a, b: lcm(a, b)) from {name}_s) as step from {name}_s),
{name}_g as (select name, ord, path, own, cf, xff, step, unnest(range(g0, g1, own)) as t from {name}_n),
{name} as (select {name}_g.name, path, ord, xff, {name}_g.step as step, t - t % {name}_g.step as ts, case when xff = 0 or count(v) / ({name}_g.step / own) >= xff then {_CONS} end as v
  from {name}_g left join merged on merged.name = {name}_g.name and merged.ts = t group by {name}_g.name, path, ord, own, cf, xff, {name}_g.step, t - t % {name}_g.step)"""


def _stored_sql() -> dict[str, str]:
    from .preparation import CANON

    head = f"with rng as (select min(start) // 3600 * 3600 as lo, max(stop) as hi from fetch_responses where step > 0 and stop > start), {_merged('fetch_responses')}, "
    shown = lambda e: f"(case when abs({e} * {1 + 3.1e-13!r}) < 1e6 then round({e} * {1 + 3.1e-13!r}, 6) else printf('%.11e', {e} * {1 + 3.1e-13!r})::double end + 0.0) as value"
    every, cpu, disk = _series("a", "*.*.*.*.*"), _series("a", "*.*.*.cpu.user_pct"), _series("b", "*.*.*.disk.used_pct")
    node = "string_split(path, '.')[{}]".format
    key = " || '.' || ".join(node(i) for i in (2, 4, 5))
    counts = _series("a", "*.*.*.requests.count")
    alone = every.replace("from series, rng", "from found, rng")
    found = f"""found as (select {CANON.format(n="name")} as name, min(step) as step, min(cons_func) as cons_func, max(case when not isnan(xff) then xff end) as xff, min(start) as start, max(stop) as stop from fetch_responses where step > 0 and stop > start and name is not null group by 1)"""
    return {
        "source_responses": f"{head}{every}, g as (select {key} as name, ts, max(v) as v from a group by 1, 2) select name, ts, {shown('v')} from g",
        "source_auto": f"{head}{found}, {alone}, g as (select {node(4)} || '.' || {node(5)} as name, ts, max(v) as v from a group by 1, 2) select name, ts, {shown('v')} from g",
        "source_query_range": f"with {_PTS} select name, ts - ts % 21600 as ts, round(sum(v), 6) + 0.0 as value from pts group by 1, 2",
        "mixed_sum": f"{head}{cpu}, g as (select 'sumSeries(*.*.*.cpu.user_pct)' as name, ts, sum(v) as v from a group by ts) select name, ts, {shown('v')} from g",
        "mixed_groupByNode": f"{head}{every}, g as (select {node(5)} as name, ts, sum(v) as v from a group by 1, 2) select name, ts, {shown('v')} from g",
        "mixed_divideSeries": f"""{head}{cpu}, {_series('b', '*.*.*.queue.depth')}, q as (select ts, max(v) as d, any_value(step) as step from b group by ts), l as (select lcm((select any_value(step) from a), (select any_value(step) from q)) as l),
x as (select name, ts - ts % l as ts, avg(v) as v from a, l group by 1, 2), y as (select ts - ts % l as ts, avg(d) as d from q, l group by 1), z as (select 'divideSeries(' || name || ',max(*.*.*.queue.depth))' as name, ts, case when d <> 0 then v / d end as v from x left join y using (ts))
select name, ts, {shown('v')} from z""",
        "mixed_asPercent": f"{head}{counts}, z as (select 'asPercent(' || name || ')' as name, ts, case when sum(v) over w <> 0 then 100 * v / sum(v) over w end as v from a window w as (partition by ts)) select name, ts, {shown('v')} from z",
        "mixed_lists": f"""{head}{cpu}, {disk}, z as (select 'maxSeries(' || a.name || ',' || b.name || ')' as name, ts, greatest(a.v, b.v) as v from a join b using (ord, ts) where ord <= 3) select name, ts, {shown('v')} from z""",
        "mixed_summarize": f"""{head}{counts}, sm as (select name, ts - ts % 21600 as ts, case when count(v) / count(*) >= xff then max(v) end as v from a group by name, xff, ts - ts % 21600), z as (select 'summarize(' || name || ',''6h'',''max'',true)' as name, ts, v from sm) select name, ts, {shown('v')} from z""",
        "mixed_consolidate": f"""{head}{_series('a', '*.*.*.limit.max_open')}, z as (select 'consolidateBy(' || name || ',"max")' as name, ts, v from a) select name, ts, {shown('v')} from z""",
    }


_DISPLAY = f"with {_PTS} select 'consolidateBy(' || name || ',\"max\")' as name, {T0} + (i // 8) * 28800 as ts, round(max(v), 6) + 0.0 as value from pts group by name, i // 8"
_MANY = f"with {_PTS} select 'sumSeries(shop.view.*)' as name, ts, 1::int as ord, round(sum(v), 6) + 0.0 as value from pts where et = 'view' group by ts union all select 'maxSeries(shop.view.*)', ts, 2, round(max(v), 6) + 0.0 from pts where et = 'view' group by ts"
_COUNTS = f"with {_PTS}, {_DAYS.format(agg='case when count(v) > 0 then count(v) end')}, l as (select dd.name, dd.ord - min(dd.ord) over () + 1 as ord, dd.ts, v, 'summarize(' || dd.name || ',''1d'',''count'')' as target, names.gr from dd left join sm using (name, ts) join names on names.name = dd.name where dd.et = 'view')"
_JSON = _COUNTS + """ select ord::int as ord, '{"target":"' || target || '","datapoints":[' || string_agg('[' || coalesce(v::bigint::varchar, 'null') || ',' || ts || ']', ',' order by ts) || '],"tags":{"name":"shop.view.' || gr || '","grp":"' || gr || '","type":"view"}}' as json from l group by ord, target, gr"""
_CSV = _COUNTS + """ select ord::int as ord, ts, '"' || target || '",' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') || ',' || coalesce(v::bigint::varchar, '') as line from l"""
_RAW = _COUNTS + f" select ord::int as ord, target || ',' || {T0} || ',' || {T1 + 86400} || ',86400|' || string_agg(coalesce(v::bigint::varchar, 'None'), ',' order by ts) as line from l group by ord, target"
_CAT = f"with c as (select distinct {NAME} as name, event_type as et, 'g' || (user_id % 3) as gr from events)"


def oracle_sql() -> dict[str, str]:
    return _stored_sql() | {
        "flagship": _FLAGSHIP, "source_shipments": _SHIP, "source_orders": _ORDERS, "source_replicas": f"with {_merged('server_responses')} select name, ts, step, v as value from merged", "display_points": _DISPLAY, "lang_targets": _MANY,
        "stream_summarize": "select event_type as name, epoch(date_trunc('hour', ts))::bigint as ts, round(sum(value), 6) + 0.0 as value from events group by 1, 2",
        "sink_json": _JSON, "sink_csv": _CSV, "sink_raw": _RAW,
        "meta_find": f"{_CAT} select distinct 'shop.' || et as id, et as text, 0::int as leaf, 1::int as expandable, 1::int as allow_children from c",
        "meta_find_leaf": f"{_CAT} select distinct 'shop.' || et || '.' || gr as id, gr as text, 1::int as leaf, 0::int as expandable, 0::int as allow_children from c where et in ('view', 'click')",
        "meta_expand": f"{_CAT} select distinct 'shop.' || et as path from c union select distinct 'shop.view.' || gr from c where et = 'view'",
        "meta_expand_grouped": f"{_CAT} select distinct 'shop.view.*' as query, 'shop.view.' || gr as path from c where et = 'view' union select distinct 'shop.*.g1', 'shop.' || et || '.g1' from c where gr = 'g1'",
        "meta_tag_names": f"{_CAT}, t as (select distinct string_split(unnest(string_split(name, ';')[2:]), '=')[1] as tag from c union select 'name') select tag from t order by tag limit 2",
        "meta_tag_values": "select distinct event_type as value from events",
        "meta_info": f"{_CAT} select distinct name, 'average' as cons_func, 0.0::double as xff, 3600::bigint as step, null::bigint as max_retention, null::bigint as number_of_points from c where et = 'view'",
        "meta_info_stored": "select name, coalesce(cons_func, 'none') as cons_func, step, stop - start as max_retention, (stop - start) // step as number_of_points from series where regexp_matches(split_part(name, ';', 1), '^[^.]*[.]web[.][^.]*[.][^.]*[.][^.]*$')",
        "meta_find_tree": f"{_CAT} select distinct 'shop.' || et as id, et as text, 0::int as leaf, 1::int as expandable, 1::int as allow_children from c",
        "meta_complete": f"{_CAT} select distinct 'shop.' || et || '.' as path, et as name, 0::int as is_leaf from c",
        "lang_matches": f"with {_PTS}, o as (select name, row_number() over (order by case et when 'view' then 0 else 1 end, case gr when 'g2' then 0 when 'g0' then 1 else 2 end)::int as ord from names where et in ('view', 'click')) select name, ts, o.ord, round(v, 6) + 0.0 as value from pts join o using (name)",
        "lang_tolerant": _MANY,
        "lang_fallback": f"with {_PTS} select name, ts, ord - min(ord) over () + 1 as ord, round(v, 6) + 0.0 as value from pts where et = 'view'",
        "fn_reduceSeries_from_end": f"with {_PTS} select a.gr as name, a.ts, round(case when b.v <> 0 then 100 * a.v / b.v end, 6) + 0.0 as value from pts a join pts b on a.gr = b.gr and a.ts = b.ts where a.et = 'click' and b.et = 'view'",
        "fn_reduceSeries_any": f"with {_PTS} select 'shop.reduce.scaleToSeconds1.' || gr as name, ts, round(abs(v), 6) + 0.0 as value from pts where et = 'view'".replace("scaleToSeconds1", "absolute"),
    }
