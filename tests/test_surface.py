"""Sources, metadata, output, streams and the entry points."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seriesloom import sinks
from seriesloom.functions import align
from seriesloom.model import frame_of
from seriesloom.plans.engine import Engine, function_catalogue
from seriesloom.sources import metadata
from seriesloom.sources.base import MemorySource, TableSource, UnionSource
from seriesloom.sources.globs import glob_regex, matches
from seriesloom.sources.responses import ResponsesSource, answers, merge_replicas


def S(name, values, step=1, start=0, **more):
    return {"name": name, "values": values, "step": step, "start": start, **more}


@pytest.mark.parametrize(
    "pattern, hits",
    [("a.*", {"a.b", "a.bc"}), ("a.?", {"a.b"}), ("a.{b,c}", {"a.b"}), ("a.b*", {"a.b", "a.bc"}), ("*.*", {"a.b", "a.bc", "x.y"}), ("a.[a-b]", {"a.b"}), ("a.[!b]*", set()), ("x.y", {"x.y"}), ("*", set()), ("{a,x}.{b,y}", {"a.b", "x.y"}),
     ("seriesByTag('k=1')", {"x.y"}), ("seriesByTag('k!=1')", {"a.b", "a.bc"}), ("seriesByTag('name=~a.*')", {"a.b", "a.bc"}), ("seriesByTag('k!=~.')", {"a.b", "a.bc"}), ("x.y;k=1", {"x.y"})],
)
def test_patterns(spark, pattern, hits):
    df = spark.createDataFrame([("a.b", "a.b", {}), ("a.bc", "a.bc", {}), ("x.y;k=1", "x.y", {"k": "1"})], "name string, path string, tags map<string,string>")
    assert {r["path"] for r in df.where(matches(pattern, F.col("name"), F.col("path"), F.col("tags"))).collect()} == hits


def test_a_pattern_is_no_regular_expression():
    assert glob_regex("a.b+c") == r"a\.b\+c"


def test_table_source_pushes_its_range_down(spark, tmp_path):
    rows = [("m", datetime(2024, 1, d), float(d)) for d in range(1, 10)] + [(None, datetime(2024, 1, 2), 1.0), ("m", None, 1.0), ("n", datetime(2024, 1, 3), None)]
    spark.createDataFrame(rows, "name string, at timestamp, v double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    src = TableSource(df, F.col("name"), F.unix_timestamp("at"), F.col("v"), 86400, "sum", "at")
    frame = Engine(spark, src).frame("m", 1704153600, 1704412800, now=0)  # 2 to 5 January
    assert [(r["ts"], r["v"]) for r in frame.points.orderBy("ts").collect()] == [(1704153600, 2.0), (1704240000, 3.0), (1704326400, 4.0)]
    plan = frame.points._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(at), GreaterThanOrEqual(at" in plan
    # an unknown value counts as no value, its slot stays absent
    assert [r["v"] for r in Engine(spark, src).frame("n", 1704153600, 1704412800, now=0).points.collect()] == [None, None, None]


def test_one_scan_per_pattern_and_range(spark):
    class Counting(MemorySource):
        seen = []

        def scan(self, pattern, start, stop):
            self.seen.append((pattern, start, stop))
            return super().scan(pattern, start, stop)

    src = Counting(spark, [S("m", list(range(20)))])
    Engine(spark, src).many(["sum(m)", "scale(m,2)", "timeShift(m,'5s')"], 10, 15, now=15)
    assert sorted(src.seen) == [("m", 5, 10), ("m", 10, 15)]


def test_union_of_sources(spark):
    src = UnionSource(MemorySource(spark, [S("m1", [1, 2])]), MemorySource(spark, [S("m2", [3, 4])]))
    got = Engine(spark, src).frame("m*", 0, 2, now=2).result().orderBy("ord", "ts").collect()
    assert [(r["name"], r["value"]) for r in got] == [("m1", 1.0), ("m1", 2.0), ("m2", 3.0), ("m2", 4.0)]
    assert src.catalogue().count() == 2


def test_replicas(spark):
    N, D = None, 86400
    rows = [
        (" m", 0, 120, 60, [1.0, N]), ("m", 30, 150, 60, [9.0, 5.0]), ("m", 0, 120, 120, [7.0]),  # one range: the finest step whole, gaps filled
        ("m", D, 2 * D, 300, [4.0, 6.0]),  # a range with coarse answers only is kept
        ("m", 0, 7200, 120, [8.0, 8.0, 8.0]),  # a wider range at a coarser step counts where nothing finer is
        ("n", 0, 120, 60, [N, float("nan")]), ("n", 0, 120, 120, [3.0, 4.0]),  # an answer without a value hides nothing; values after the stop do not count
        (None, 0, 60, 60, [1.0]), ("m", 0, 60, 0, [1.0]), ("m", 0, 60, 60, None), ("m", N, 60, 60, [1.0]),
    ]
    df = spark.createDataFrame(rows + rows[:2], "name string, start long, stop long, step long, vals array<double>").withColumn("h0", F.lit("clash"))
    got = sorted((r["name"], r["ts"], r["step"], r["v"]) for r in merge_replicas(answers(df)).collect())
    assert got == [("m", 0, 60, 9.0), ("m", 60, 60, 5.0), ("m", 120, 120, 8.0), ("m", 240, 120, 8.0), ("m", D, 300, 4.0), ("m", D + 300, 300, 6.0), ("n", 0, 120, 3.0)]


def test_stored_responses_as_series(spark):
    series = spark.createDataFrame([("a.b;k=1", 0, 86400, 60, None, None), ("a.c", 0, 86400, 120, "sum", 0.5)], "name string, start long, stop long, step long, cons_func string, xff double")
    resp = spark.createDataFrame([(" a..b;k=1", 0, 240, 60, [1.0, None, float("nan"), 4.0]), ("a.c", 0, 240, 120, [10.0, 20.0]), (None, 0, 60, 60, [1.0])], "name string, start long, stop long, step long, vals array<double>")
    got = Engine(spark, ResponsesSource(resp, series)).frame("sum(a.*)", 0, 240, now=240).result().orderBy("ts").collect()
    assert [(r["ts"], r["value"]) for r in got] == [(0, 11.0), (120, 24.0)]


def test_a_source_by_the_columns_of_a_table(spark):
    from seriesloom.sources.auto import open_source

    resp = spark.createDataFrame([(" a..b", 0, 240, 60, [1.0, None, 3.0]), ("a.b", 120, 360, 120, [9.0, 8.0]), (None, 0, 60, 60, [1.0]), ("a.c", 0, 60, 0, [1.0])], "name string, start long, stop long, step long, vals array<double>")
    got = Engine(spark, open_source(resp)).frame("a.*", 0, 360, now=360).result().orderBy("ts").collect()
    assert [(r["name"], r["ts"], r["value"]) for r in got] == [("a.b", 0, 1.0), ("a.b", 60, None), ("a.b", 120, 3.0), ("a.b", 180, None), ("a.b", 240, 8.0), ("a.b", 300, None)]
    rows = spark.createDataFrame([("m", 0, 1.0), ("m", 30, 3.0), ("m", 60, 5.0)], "name string, ts long, value double")
    got = Engine(spark, open_source(rows)).frame("m", 0, 120, now=120).result().orderBy("ts").collect()
    assert [(r["ts"], r["value"]) for r in got] == [(0, 2.0), (60, 5.0)]
    timed = rows.withColumn("ts", F.timestamp_seconds("ts"))
    assert Engine(spark, open_source(timed)).frame("m", 0, 60, now=60).result().first()["value"] == 2.0
    with pytest.raises(ValueError):
        open_source(rows.drop("value"))


def test_find_and_tags(spark):
    src = MemorySource(spark, [S("a.b.c;k=1;z=2", [1]), S("a.b", [1]), S("a.d.e;k=3", [1]), S("_tagged.x", [1])])
    found = {(r["id"], r["leaf"], r["expandable"]) for r in metadata.find(src, "a.*").collect()}
    assert found == {("a.b", 1, 0), ("a.b", 0, 1), ("a.d", 0, 1)}
    assert metadata.find(src, "_tag*").count() == 0
    assert [r[0] for r in metadata.tag_names(src).collect()] == ["k", "name", "z"]
    assert [r[0] for r in metadata.tag_values(src, "k", "", 1).collect()] == ["1"]
    assert {r["path"] for r in metadata.expand(src, ["a.*", "a.*.*"], leaves_only=True).collect()} == {"a.b", "a.b.c", "a.d.e"}
    info = metadata.info(src, "a.b").first()
    assert (info["step"], info["max_retention"], info["number_of_points"]) == (1, 1, 1)
    assert [(r["id"], r["leaf"]) for r in metadata.find(src, "a.*").collect()] == [("a.b", 0), ("a.d", 0), ("a.b", 1)]
    assert [(r["id"], r["leaf"]) for r in metadata.find_tree(src, "a.*").collect()] == [("a.b", 0), ("a.d", 0)]
    assert [(r["path"], r["is_leaf"]) for r in metadata.complete(src, "a.*").collect()] == [("a.b.", 0), ("a.d.", 0), ("a.b", 1)]


def test_output(spark):
    f = frame_of(spark, [S('m"x;k=v', [1, None, float("inf"), 2.5], 10, 100)])
    row = json.loads(sinks.to_json(f).first()["json"])
    assert row["target"] == 'm"x;k=v' and row["datapoints"] == [[1, 100], [None, 110], [None, 120], [2.5, 130]] and row["tags"]["k"] == "v"
    assert json.loads(sinks.to_json(f, no_null_points=True, unit="ms").first()["json"])["datapoints"] == [[1, 100000], [None, 120000], [2.5, 130000]]
    assert sinks.to_raw(f).first()["line"] == 'm"x;k=v,100,140,10|1,None,None,2.5'
    assert [r["line"] for r in sinks.to_csv(f).orderBy("ts").collect()][:2] == ['"m"x;k=v",1970-01-01 00:01:40,1', '"m"x;k=v",1970-01-01 00:01:50,']


def test_display_consolidation(spark):
    f = frame_of(spark, [S("m", [1, 2, 3, 4, None, None, 7], 10, 0, cons_func="max"), S("n", [1, 2, 3, 4, 5, 6, 7], 10, 0)])
    got = align.max_points(f, 3).result().orderBy("ord", "ts").collect()
    assert [(r["name"], r["ts"], r["value"]) for r in got] == [("m", 0, 3.0), ("m", 30, 4.0), ("m", 60, 7.0), ("n", 0, 2.0), ("n", 30, 5.0), ("n", 60, 7.0)]
    assert align.max_points(f, 100).result().count() == 14
    late = frame_of(spark, [S("m", [1, 2, 3, 4, 5], 3, 4, cons_func="sum")])
    blocks = lambda **k: [(r["ts"], r["value"]) for r in align.max_points(late, 3, **k).result().orderBy("ts").collect()]
    assert blocks() == [(4, 3.0), (10, 7.0), (16, 5.0)]
    assert blocks(stamp_last=True) == [(7, 3.0), (13, 7.0), (16, 5.0)]
    # blocks of six seconds begin at 3, 9, 15: the first point is left out
    assert blocks(nudge=True) == [(7, 5.0), (13, 9.0)]


@pytest.mark.parametrize("span, most, least, step", [(600, 1000, 10, 10), (3600, 100, 10, 60), (86400, 1000, 15, 120), (10**9, 100, 15, 86400), (30, 1, 15, 30)])
def test_steps_of_a_range(span, most, least, step):
    assert align.choose_step(0, span, most, least) == step
    assert align.choose_step(0, span, most, least, span + 1) == least


def test_common_step_uses_each_series_own_function(spark):
    f = frame_of(spark, [S("s", [1, 2, 3, 4], 1, 0, cons_func="sum"), S("m", [5, None, 7, 8], 1, 0, cons_func="max", xff=0.9), S("c", [1, 2], 2, 0)])
    assert align.lcm_step(f) == 2
    got = align.to_step(f, 2).result().orderBy("ord", "ts").collect()
    assert [r["value"] for r in got] == [3.0, 7.0, None, 8.0, 1.0, 2.0]


def test_streamed_buckets_equal_those_at_rest(spark, tmp_path):
    from seriesloom.streaming.summaries import distinct_readings, summarize_stream

    rows = [("a", datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 50, 5)] + [("b", datetime(2024, 1, 1, 0, 7), None), ("a", datetime(2024, 1, 1, 0, 5), 5.0)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "name string, ts timestamp, v double").coalesce(1).write.parquet(str(src))
    stream = distinct_readings(spark.readStream.schema("name string, ts timestamp, v double").parquet(str(src)), ["name", "ts"])
    out = summarize_stream(stream, "10 minutes", "sum", late=None)
    query = out.writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["name"], r["ts"]): r["value"] for r in spark.table("buckets").collect()}
    rest = {(r["name"], r["ts"]): r["value"] for r in summarize_stream(spark.read.parquet(str(src)).dropDuplicates(["name", "ts"]), "10 minutes", "sum").collect()}
    # the watermark keeps the last buckets open
    assert got and all(rest[k] == v for k, v in got.items()) and len(rest) - len(got) <= 2


def test_catalogue_of_functions(spark):
    rows = {r["name"]: r for r in function_catalogue(spark).collect()}
    assert len(rows) >= 210 and rows["sumSeries"]["description"] and rows["scale"]["signature"] == "scale(seriesList, factor, timestamp=0)"


def test_entry_points(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {"p1_found", "p2_found", "p3_found"} <= set(q)
    df = entry.entry(spark)
    assert df.columns == ["name", "ts", "ord", "value"] and df.count() > 0


def test_queries_against_their_sql(spark, tables):
    """A few of the queries; the driver compares them all."""
    import os

    import duckdb

    import __spark_entry__ as entry

    if not os.path.isdir(tables):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in os.listdir(tables):
        con.execute(f"create view {t.split('.')[0]} as select * from '{tables}/{t}'")
    q, sql = entry.queries(), entry.oracle_sql()
    for name in ("p1_found", "p2_found", "p2_grid", "flagship", "fn_movingAverage", "fn_asPercent_missing", "source_replicas"):
        got = sorted((tuple(str(r[c]) for c in sorted(r.asDict())) for r in q[name](spark, tables).collect()))
        cols = [d[0] for d in con.execute(sql[name]).description]
        want = sorted(tuple(str(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in con.execute(sql[name]).fetchall())
        assert got == want, name


def test_stored_responses_are_read_whole(spark, tables):
    from pyspark.sql import functions as F
    from seriesloom.queries import catalogue
    from seriesloom.session import read

    out = catalogue.queries()["source_responses"](spark, tables).where("value is not null").agg(F.min("ts"), F.max("ts"), F.collect_set("name")).first()
    series = read(spark, tables, "series")
    lo, hi = series.agg(F.min("start"), F.max("stop")).first()
    assert out[0] < lo + 86400 and out[1] >= hi - 7 * 86400
    nodes = F.split(F.split("name", ";")[0], r"\.")
    assert set(out[2]) == {r[0] for r in series.select(F.concat_ws(".", nodes[1], nodes[3], nodes[4])).distinct().collect()}


def test_holt_winters_queries_take_every_event_type(spark, tables):
    from seriesloom.queries import catalogue

    names = {r["name"] for r in catalogue.queries()["fn_holtWintersForecast"](spark, tables).select("name").distinct().collect()}
    assert {n.split("shop.")[1].split(".")[0] for n in names} == {r[0] for r in spark.read.parquet(f"{tables}/events.parquet").select("event_type").distinct().collect()}
