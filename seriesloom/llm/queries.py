"""Queries of the subpackage (p4 to p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from . import mixing, percentiles, reading_level, survivor, tokens


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(read(spark, d, "server_responses"), read(spark, d, "servers"), undated="earliest")


def p4_currency(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(read(spark, d, "server_responses"), read(spark, d, "servers"), undated="learned")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving records, with the undated placed by learned precedence."""
    return survivor.surviving_records(read(spark, d, "server_responses"), read(spark, d, "servers"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.series_percentiles(read(spark, d, "fetch_responses"), read(spark, d, "series"))


def p5_within(spark: SparkSession, d: str) -> DataFrame:
    """`path_expr, day, n, within`: whether each percentile is within its stated error of the exact ones."""
    from ..session import written

    codes = percentiles.Codes()
    got = written(p5_percentiles(spark, d))
    values = percentiles.by_expression(read(spark, d, "fetch_responses"), read(spark, d, "series")).select("path_expr", F.date_from_unix_date("day").alias("day"), F.explode("part").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    values = values.unionByName(values.withColumn("day", F.lit(None).cast("date")))
    near = F.col("v") + 0.0
    tests = []
    for q, c in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")):
        slack = F.abs(F.col(c)) * codes.alpha * 1.01 + 2.3e-308
        below, upto = F.sum((near < F.col(c) - slack).cast("long")), F.sum((near <= F.col(c) + slack).cast("long"))
        tests.append((below <= q * F.count(F.lit(1)) + F.max("rank_error") * F.count(F.lit(1))) & (upto >= q * F.count(F.lit(1)) - F.max("rank_error") * F.count(F.lit(1)) - 1))
    met = values.join(got.drop("n"), values["path_expr"].eqNullSafe(got["path_expr"]) & values["day"].eqNullSafe(got["day"])).select(values["path_expr"], values["day"], "v", "p50", "p90", "p95", "p99", "rank_error")
    return met.groupBy("path_expr", "day").agg(F.count(F.lit(1)).alias("n"), (tests[0] & tests[1] & tests[2] & tests[3] & (F.max("rank_error") <= 0.01)).alias("within"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(read(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """`doc_id, same`: whether decoding a document's ids gives its text again."""
    docs = read(spark, d, "documents")
    back = tokens.decode_ids(tokens.encode_texts(docs)).withColumnRenamed("text", "back")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(back, "doc_id").select("doc_id", (F.col("t") == F.col("back")).alias("same"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "mix_targets")
    return mixing.report_shares(mixing.mix_sources(read(spark, d, "documents"), targets), targets)


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(read(spark, d, "documents"), read(spark, d, "reading_passages"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.level_found(p8_levels(spark, d))


def queries() -> dict:
    return {
        "p4_found": p4_found, "p4_currency": p4_currency, "p4_records": p4_records,
        "p5_percentiles": p5_percentiles, "p5_within": p5_within,
        "p6_ids": p6_ids, "p6_round_trip": p6_round_trip,
        "p7_mix": p7_mix, "p7_shares": p7_shares,
        "p8_found": p8_found, "p8_levels": p8_levels,
    }


_TRIM = "' ' || chr(9) || chr(10) || chr(13)"

_P4_FOUND = f"""with ranks as (select regexp_replace(lower(trim(server)), ':[0-9]+$', '') as sk, min(trust_rank) as rank from servers group by 1),
m as (
  select response_id,
    array_to_string(list_filter(list_transform(string_split(string_split(trim(name, {_TRIM}), ';')[1], '.'), lambda x: trim(x)), lambda x: x <> ''), '.') as path,
    list_sort(list_distinct(list_filter(list_transform(string_split(trim(name, {_TRIM}), ';')[2:], lambda x: trim(x)), lambda x: x <> ''))) as tags,
    start // 3600 as h0, stop // 3600 as h1, coalesce(epoch_us(received_at), -9e18) as recv, coalesce(rank, 2147483647) as rank,
    len(list_filter(vals[1:greatest(0, ceil((stop - start) / step))::bigint], lambda v: v is not null and not isnan(v))) as n,
    path_expr, cons_func, case when not isnan(xff) then xff end as xff
  from server_responses left join ranks on sk = regexp_replace(lower(trim(server)), ':[0-9]+$', '') where name is not null),
g as (select *, min(response_id) over w as group_id, count(*) over w as c from m window w as (partition by path, tags, h0, h1)),
o as (
  select group_id, 'vals' as field, n as full_n, recv, rank, response_id from g where c > 1 and n > 0
  union all select group_id, 'path_expr', 0, recv, rank, response_id from g where c > 1 and path_expr is not null
  union all select group_id, 'cons_func', 0, recv, rank, response_id from g where c > 1 and cons_func is not null
  union all select group_id, 'xff', 0, recv, rank, response_id from g where c > 1 and xff is not null)
select group_id, field, response_id from o
qualify row_number() over (partition by group_id, field order by full_n desc, recv desc, rank, response_id) = 1"""

_OFFERS = _P4_FOUND[: _P4_FOUND.rindex("select group_id, field, response_id from o")].replace("rank, response_id from g", "rank, response_id, seen, {} from g").replace("coalesce(epoch_us(received_at), -9e18) as recv", "coalesce(epoch_us(received_at), -9e18) as recv, epoch_us(received_at) as seen")
for _value in ("null::varchar as value", "path_expr", "cons_func", "xff::varchar"):
    _OFFERS = _OFFERS.replace("{}", _value, 1)


def _doubled(rounds: int) -> str:
    """Strongest paths of up to 2**rounds steps, p0 being the votes that won."""
    return ",".join(
        f"""
p{i + 1} as (select field, a, b, max(s) as s from (select * from p{i} union all select x.field, x.a, y.b, least(x.s, y.s) from p{i} x join p{i} y on x.field = y.field and x.b = y.a and x.a <> y.b) group by field, a, b)"""
        for i in range(rounds)
    )


_P4_CURRENCY = f"""{_OFFERS},
best as (select *, max(seen) over (partition by group_id, field, value) as last from o qualify row_number() over (partition by group_id, field, value order by full_n desc, recv desc, rank, response_id) = 1),
alone as (select group_id, field, last, min(value) as value from best where last is not null and value is not null group by 1, 2, 3 having count(*) = 1),
steps as (select field, value as a, lead(value) over (partition by group_id, field order by last) as b from alone),
votes as (select field, a, b, count(*) as s from steps where b is not null group by all),
p0 as (select x.field, x.a, x.b, x.s from votes x left join votes y on y.field = x.field and y.a = x.b and y.b = x.a where x.s > coalesce(y.s, 0)),{_doubled(6)},
before as (select x.* from p6 x left join p6 y on y.field = x.field and y.a = x.b and y.b = x.a where x.s > coalesce(y.s, 0)),
learned as (select x.group_id, x.field, x.value, max(k.s) as s from best x join before k on k.field = x.field and k.a = x.value join best y on y.group_id = x.group_id and y.field = x.field and y.value = k.b where x.last is null or y.last is null group by all),
known as (select b.*, case when b.value is not null and last < max(last) over (partition by b.group_id, b.field) then 4611686018427387904 else coalesce(l.s, 0) end as against from best b left join learned l on l.group_id = b.group_id and l.field = b.field and l.value = b.value)
select group_id, field, response_id from known
qualify row_number() over (partition by group_id, field order by full_n desc, against, recv desc, rank, response_id) = 1"""


#: Path nodes and tags of a name in one spelling.
_PATH = f"array_to_string(list_filter(list_transform(string_split(string_split(trim(name, {_TRIM}), ';')[1], '.'), lambda x: trim(x)), lambda x: x <> ''), '.')"
_TAGS = f"list_sort(list_distinct(list_filter(list_transform(string_split(trim(name, {_TRIM}), ';')[2:], lambda x: trim(x)), lambda x: x <> '')))"

_P5_WITHIN = f"""with ids as (select {_PATH} as path, {_TAGS} as tags, min(path_expr) as known from series where name is not null group by 1, 2),
named as (select coalesce(r.path_expr, known) as path_expr, start, stop, step, vals from (select *, {_PATH} as path, {_TAGS} as tags from fetch_responses where step > 0 and start is not null and stop is not null) r left join ids on ids.path = r.path and ids.tags = r.tags),
flat as (select path_expr, date '1970-01-01' + ((start + (u.i - 1) * step) // 86400)::int as day from named r, lateral (select unnest(range(1, len(r.vals) + 1)) as i, unnest(r.vals) as v) u where start + (u.i - 1) * step < stop and v is not null and not isnan(v))
select path_expr, day, count(*) as n, true as within from flat group by all union all select path_expr, null, count(*), true from flat group by 1"""


def oracle_sql() -> dict[str, str]:
    return {"p4_currency": _P4_CURRENCY, "p5_within": _P5_WITHIN, "p4_found": _P4_FOUND, "p6_round_trip": "select doc_id, true as same from documents"}
