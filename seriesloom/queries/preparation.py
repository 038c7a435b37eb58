"""Queries of the core's data-preparation problems (p1 to p3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.implausible import ANY, EXPECTED, HABIT, IMPOSSIBLE, LEAST_RUN, STUCK, UNITS, implausible_found, implausible_values
from ..operators.regular_grid import empty_periods, regular_grid
from ..operators.rolling import inactive_days, rolling_totals
from ..session import read


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals(read(spark, d, "fetch_responses"), read(spark, d, "series"))


def p1_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals to three decimals (very large ones to whole numbers or nine digits), averages of those: sums of doubles depend on their order."""
    rounded = {}
    for p in (7, 30):
        t = F.col(f"total_{p}")
        rounded[f"total_{p}"] = F.when(F.abs(t) < 1e12, F.round(t, 3)).when(F.abs(t) < 1e16, F.round(t, 0)).otherwise(F.format_string("%.8e", t).cast("double"))
        rounded[f"avg_{p}"] = F.when(F.col(f"n_{p}") > 0, rounded[f"total_{p}"] / F.col(f"n_{p}"))
    return _rolling(spark, d).withColumns(rounded)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return inactive_days(_rolling(spark, d))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(read(spark, d, "readings"), read(spark, d, "scrape_targets"))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).withColumn("v", F.round("v", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return empty_periods(_grid(spark, d))


def p3_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible_values(read(spark, d, "fetch_responses"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible_found(p3_flags(spark, d))


def _reason(reason: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return implausible_found(p3_flags(spark, d).where(F.array_contains("reasons", reason)))

    return query


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_rolling": p1_rolling, "p2_found": p2_found, "p2_grid": p2_grid,
        "p3_found": p3_found, "p3_flags": p3_flags, "p3_stuck": _reason(STUCK), "p3_impossible": _reason(IMPOSSIBLE),
    }


#: One spelling per series name, as canonical_name() has it.
CANON = """(
  array_to_string(list_filter(list_transform(string_split(string_split(trim({n}, ' ' || chr(9) || chr(10) || chr(13)), ';')[1], '.'), lambda x: trim(x)), lambda x: x <> ''), '.')
  || coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(trim({n}, ' ' || chr(9) || chr(10) || chr(13)), ';')[2:], lambda x: trim(x)), lambda x: x <> ''), lambda x: {{'k': string_split(x, '=')[1], 't': x}}))), lambda x: ';' || x.t), ''), ''))"""

_PLACED = f"""
ids as (select {CANON.format(n="name")} as cname, min(sid) as sid from series where name is not null group by 1),
flat as (
  select i.sid, r.step, r.start + (u.i - 1) * r.step as ts, u.v
  from (select *, {CANON.format(n="name")} as cname from fetch_responses where step > 0 and len(vals) > 0) r
  join ids i using (cname), lateral (select unnest(range(1, len(r.vals) + 1)) as i, unnest(r.vals) as v) u
  where r.start + (u.i - 1) * r.step < r.stop and u.v is not null and not isnan(u.v)),
slots as (select sid, ts - ts % step as slot, max(v) as v, ts // 86400 as day from flat group by sid, ts - ts % step, ts // 86400),
daily as (select sid, day, sum(v) as total, count(v) as n, min(v) as low, max(v) as high from slots group by 1, 2),
days as (select sid, unnest(range(start // 86400, (stop + 86399) // 86400)) as day from (select sid, min(start) as start, max(stop) as stop from series group by sid))"""

_P1_FOUND = f"""with {_PLACED}
select d.sid, strftime(date '1970-01-01' + d.day::int, '%Y-%m-%d') as day
from days d left join daily a on a.sid = d.sid and a.day = d.day where a.sid is null"""


def _period(p: int) -> str:
    return f"""coalesce(sum(a.total) filter (a.day > d.day - {p}), 0.0) as total_{p},
  sum(a.total) filter (a.day > d.day - {p}) / sum(a.n) filter (a.day > d.day - {p}) as avg_{p},
  min(a.low) filter (a.day > d.day - {p}) as min_{p}, max(a.high) filter (a.day > d.day - {p}) as max_{p},
  coalesce(sum(a.n) filter (a.day > d.day - {p}), 0)::bigint as n_{p}"""


_P1_ROLLING = f"""with {_PLACED},
wide as (select d.sid, d.day, coalesce(max(a.n) filter (a.day = d.day), 0)::bigint as n_day, {_period(7)}, {_period(30)}
  from days d left join daily a on a.sid = d.sid and a.day between d.day - 29 and d.day group by 1, 2)
select sid, date '1970-01-01' + day::int as day, n_day > 0 as active, n_day,
  case when abs(total_7) < 1e12 then round(total_7, 3) when abs(total_7) < 1e16 then round(total_7, 0) else printf('%.8e', total_7)::double end as total_7, case when n_7 > 0 then (case when abs(total_7) < 1e12 then round(total_7, 3) when abs(total_7) < 1e16 then round(total_7, 0) else printf('%.8e', total_7)::double end) / n_7 end as avg_7, min_7, max_7, n_7, case when abs(total_30) < 1e12 then round(total_30, 3) when abs(total_30) < 1e16 then round(total_30, 0) else printf('%.8e', total_30)::double end as total_30, case when n_30 > 0 then (case when abs(total_30) < 1e12 then round(total_30, 3) when abs(total_30) < 1e16 then round(total_30, 0) else printf('%.8e', total_30)::double end) / n_30 end as avg_30, min_30, max_30, n_30 from wide"""

_TIMED = """
clean as (
  select r.target_id, s.step, case when abs(r.ts) >= 1e11 then r.ts / 1000.0 else r.ts end as t, r.v
  from readings r join (select target_id, min(step) as step from scrape_targets where step > 0 group by 1) s using (target_id)
  where r.ts is not null and not isnan(r.ts) and r.ts > 0 and r.ts < 1e15 and r.v is not null and not isnan(r.v)),
once as (select distinct target_id, step, floor(t / step)::bigint as slot, t, v from clean),
timed as (select target_id, step, slot, t, avg(v) as v from once group by all),
per as (select o.target_id, o.step, o.slot, avg(o.v) as v, count(*) as n from once o group by all),
ends as (select target_id, slot, min(t) as t0, arg_min(v, t) as v0, max(t) as t1, arg_max(v, t) as v1 from timed group by all),
linked as (
  select p.*, e.t1, e.v1,
    lead(p.slot) over w as nslot, lead(e.t0) over w as nt0, lead(e.v0) over w as nv0
  from per p join ends e using (target_id, slot) window w as (partition by p.target_id order by p.slot))"""

_P2_FOUND = f"""with {_TIMED}
select target_id, unnest(range(slot + 1, nslot)) * step as slot_ts from linked where nslot > slot + 1"""

_P2_GRID = f"""with {_TIMED},
holes as (select target_id, step, t1, v1, nt0, nv0, unnest(range(slot + 1, nslot)) as slot from linked where nslot > slot + 1)
select target_id, slot * step as slot_ts, round(v, 6) as v, 'observed' as how, n from linked
union all
select target_id, slot * step, case when nt0 - t1 <= 10 * step then round(v1 + (nv0 - v1) * (((slot + 0.5) * step - t1) / (nt0 - t1)), 6) end,
  case when nt0 - t1 <= 10 * step then 'interpolated' else 'gap' end, 0 from holes"""


_SENT = f"""sent as (
  select r.fetch_id, r.cname, r.step, r.start + (u.i - 1) * r.step as ts, (r.start + (u.i - 1) * r.step) // r.step as slot, u.v
  from (select *, {CANON.format(n="name")} as cname from fetch_responses where step > 0 and len(vals) > 0 and name is not null) r, lateral (select unnest(range(1, len(r.vals) + 1)) as i, unnest(r.vals) as v) u
  where r.start + (u.i - 1) * r.step < r.stop and u.v is not null and not isnan(u.v)),
held as (select cname, step, slot, max(v) as v from sent group by all)"""

_UNITS = " union all ".join(f"select '{u}' as unit, {a!r}::double as low, {b!r}::double as high" for u, (a, b) in UNITS.items())

_P3_IMPOSSIBLE = f"""with {_SENT}, units as ({_UNITS}),
bad as (select cname, step, slot from held left join units on unit = lower(regexp_extract(split_part(cname, ';', 1), '([A-Za-z]+)$', 1)) where v < coalesce(low, {ANY[0]!r}::double) or v > coalesce(high, {ANY[1]!r}::double))
select distinct fetch_id, ts from sent join bad using (cname, step, slot)"""

_P3_STUCK = f"""with {_SENT},
marked as (select *, coalesce((v <> lag(v) over (partition by cname, step order by slot))::int, 1) as fresh from held),
placed as (select *, sum(fresh) over (partition by cname, step order by slot rows unbounded preceding) as run from marked),
runs as (select cname, step, run, any_value(v) as v, count(*) as len from placed group by all),
series_of as (select cname, step, count(*) as runs, sum(len - 1) as repeats from runs group by all),
again as (select cname, step, v, count(*) as times, sum(len) as held from runs where len >= 2 group by all),
judged as (select r.*, s.runs, greatest((repeats - (len - 1) + 0.5) / (repeats - (len - 1) + s.runs + 1),
    case when times >= {LEAST_RUN} then (held - 2 * times - (len - 2) + 0.5) / (held - times - (len - 1) + 1) else 0 end) as chance
  from runs r join series_of s using (cname, step) join again using (cname, step, v) where len >= {LEAST_RUN} and len <= {HABIT} * (s.runs + repeats)),
stuck as (select cname, step, run from judged where runs * pow(chance, len - 1) < {EXPECTED})
select distinct fetch_id, ts from sent join (select cname, step, slot from placed join stuck using (cname, step, run)) using (cname, step, slot)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1_FOUND, "p1_rolling": _P1_ROLLING, "p2_found": _P2_FOUND, "p2_grid": _P2_GRID, "p3_stuck": _P3_STUCK, "p3_impossible": _P3_IMPOSSIBLE}
