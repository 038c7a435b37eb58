"""Series from stored fetch responses, with the answers of several servers merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SERIES, SeriesFrame, renumber, tags_of
from ..operators.responses import canonical_name, present
from .base import dense
from .globs import match_order, matches


def answers(responses: DataFrame) -> DataFrame:
    """`name, h0, h1, start, stop, step, n, vals` of the answers with a present value before their stop.

    `h0` and `h1` are the requested range in full hours; what falls at or after
    `stop` is cut off, and an answer without a value says nothing.
    """
    slim = responses.select(canonical_name("name").alias("name"), "start", "stop", "step", "vals").where((F.col("step") > 0) & (F.col("stop") > F.col("start")) & F.col("name").isNotNull())
    n = F.least(F.size("vals").cast("long"), F.ceil(F.try_divide(F.col("stop") - F.col("start"), F.col("step"))).cast("long"))
    cut = slim.withColumn("n", n).where("n > 0").withColumn("vals", F.slice("vals", F.lit(1), F.col("n").cast("int")))
    hour = lambda c: F.floor(F.col(c) / 3600).cast("long")
    return cut.where(F.exists("vals", present)).select("name", hour("start").alias("h0"), hour("stop").alias("h1"), "start", "stop", "step", F.size("vals").alias("n"), "vals")


def merge_replicas(rows: DataFrame, key: str = "name") -> DataFrame:
    """`key, ts, step, v` of all answers() for the same series, told apart by `key`.

    Of the answers to one requested range those with the finest step are kept
    whole, and of the others what lies before or after all of them. Where ranges
    overlap, each slot has the value of the finest step there, and of equal steps
    that of the longest answer, so gaps of one are filled from others. Steps are
    compared row by row, before any value is unpacked.
    """
    spans = rows.groupBy(key, "h0", "h1", "step").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"))
    finest = spans.groupBy(key, "h0", "h1").agg(F.min("step").alias("finest"), F.min_by("lo", "step").alias("lo"), F.min_by("hi", "step").alias("hi"))
    inside = F.col("step") > F.col("finest")
    kept = rows.join(finest, [key, "h0", "h1"]).where(~inside | (F.col("start") < F.col("lo")) | (F.col("stop") > F.col("hi")))
    # ranges delivered again as they were drop out before they are unpacked
    beyond = [F.when(inside, F.col(c)).alias(c) for c in ("lo", "hi")]
    once = kept.select(key, "start", "step", "n", "vals", *beyond).distinct()
    each = once.select(key, "start", "step", "n", "lo", "hi", F.posexplode("vals").alias("i", "v")).where(present(F.col("v")))
    ts = F.col("start") + F.col("i") * F.col("step")
    slot = ts - F.pmod(ts, F.col("step"))
    each = each.where(F.col("lo").isNull() | (slot + F.col("step") <= F.col("lo")) | (slot >= F.col("hi")))
    # the finer step first, then the longer answer, then the larger value: hashed aggregates of plain numbers
    place = F.col("n") - F.col("step") * F.lit(2**31)
    slots = each.select(key, "step", slot.alias("ts"), "v", place.alias("place")).repartition(key, "ts")
    best = slots.groupBy(key, "ts", "step", "place").agg(F.max("v").alias("v"))
    return best.groupBy(key, "ts").agg(F.max_by("v", "place").alias("v"), F.min("step").alias("step"))


class ResponsesSource:
    """The tables `series` (catalogue) and `fetch_responses` or `server_responses` as a source."""

    def __init__(self, responses: DataFrame, series: DataFrame):
        self.responses, self.dims = responses, series

    def scan(self, pattern: str, start: int, stop: int) -> SeriesFrame:
        path = F.split("name", ";")[0]
        dims = self.dims.select((F.col("sid") if "sid" in self.dims.columns else F.lit(0)).alias("id"), "name", "cons_func", "xff", F.col("start").alias("s0"), F.col("stop").alias("s1"), "step").where(F.col("name").isNotNull() & (F.col("step") > 0))
        dims = dims.where(matches(pattern, F.col("name"), path, tags_of(F.col("name")))).where((F.col("s0") < stop) & (F.col("s1") > start))
        # of rows with one name the one with the smallest sid is the series
        dims = dims.groupBy("name").agg(F.min_by(F.struct("cons_func", "xff", "s0", "s1", "step"), F.struct("id", "s0", "s1", "step")).alias("d")).select("name", "d.*")
        dims = dims.withColumn("sid", F.xxhash64("name"))
        up = lambda c: (F.ceil(c / F.col("step")) * F.col("step")).cast("long")
        series = renumber(
            dims.select(
                "sid", F.lit(0).alias("ord"), "name", F.lit(pattern).alias("path_expr"), tags_of(F.col("name")).alias("tags"),
                up(F.lit(start)).alias("start"), up(F.lit(stop)).alias("stop"), "step",
                F.coalesce("cons_func", F.lit("average")).alias("cons_func"), F.coalesce(F.nanvl("xff", F.lit(0.0)), F.lit(0.0)).alias("xff"),
                F.from_json(F.lit("{}"), "map<string,string>").alias("opts"),
            ),
            *match_order(pattern, F.col("name")),
        ).select(*SERIES)
        rows = answers(self.responses.where((F.col("start") < stop) & (F.col("stop") > start)))
        rows = rows.withColumn("sid", F.xxhash64("name")).join(series.select("sid"), "sid", "left_semi")
        merged = merge_replicas(rows, "sid").where((F.col("ts") >= start) & (F.col("ts") < stop))
        return SeriesFrame(series, dense(series, merged), None)

    def catalogue(self) -> DataFrame:
        return self.dims.where(F.col("name").isNotNull()).select("name", F.split("name", ";")[0].alias("path"), tags_of(F.col("name")).alias("tags"), "step", "cons_func", "xff", (F.col("stop") - F.col("start")).alias("retention"))
