"""Sources: what a planner reads series from."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.parser import TAG_QUERY
from ..model import POINTS_DDL, SERIES, SERIES_DDL, SeriesFrame, empty_map, frame_of, renumber, tags_of
from .globs import match_order, matches


class SeriesSource(Protocol):
    """`scan` gives the series of a pattern over [start, stop); `catalogue` all series for metadata queries."""

    def scan(self, pattern: str, start: int, stop: int) -> SeriesFrame: ...

    def catalogue(self) -> DataFrame: ...


def dense(series: DataFrame, raw: DataFrame) -> DataFrame:
    """Points of every grid slot: the grid of each series meets its values on (sid, ts)."""
    grid = series.where(F.col("stop") > F.col("start")).select("sid", F.explode(F.sequence(F.col("start"), F.col("stop") - F.col("step"), F.col("step"))).alias("ts"))
    return grid.join(raw.select("sid", "ts", "v"), ["sid", "ts"], "left")


class TableSource:
    """Rows of any table as series: each row has a name, a time and a value.

    `name`, `ts` (epoch seconds) and `v` are columns of the table; values of one
    slot are aggregated by built-in functions with partial aggregation, and the
    range goes to the scan as a predicate on `time_column` where that is given.
    """

    def __init__(self, df: DataFrame, name: Column, ts: Column, v: Column | None, step: int, how: str = "sum", time_column: str | None = None, cons_func: str = "average", xff: float = 0.0):
        self.df, self.name, self.ts, self.v, self.step = df, name, ts, v, step
        self.how, self.time_column, self.cons_func, self.xff = how, time_column, cons_func, xff

    def at_step(self, step: int) -> "TableSource":
        """The same rows on another grid."""
        return TableSource(self.df, self.name, self.ts, self.v, step, self.how, self.time_column, self.cons_func, self.xff)

    def _slots(self, start: int | None, stop: int | None) -> DataFrame:
        rows = self.df
        if self.time_column and start is not None:
            from .tables import moment

            c = F.col(self.time_column)
            rows = rows.where((c >= moment(rows, self.time_column, start)) & (c < moment(rows, self.time_column, stop)))
        slim = rows.select(self.name.alias("name"), (self.ts - F.pmod(self.ts, F.lit(self.step))).cast("long").alias("ts"), (self.v if self.v is not None else F.lit(1.0)).cast("double").alias("v"))
        if start is not None:
            slim = slim.where((F.col("ts") >= start) & (F.col("ts") < stop))
        return slim.where(F.col("name").isNotNull())

    def scan(self, pattern: str, start: int, stop: int) -> SeriesFrame:
        lo, hi = -(-start // self.step) * self.step, -(-stop // self.step) * self.step
        path = F.split("name", ";")[0]
        hit = self._slots(lo, hi).where(matches(pattern, F.col("name"), path, tags_of(F.col("name")))).withColumn("sid", F.xxhash64("name"))
        agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}[self.how]
        # keyed by sid, so that the grid meets the slots in the exchange of this aggregate
        slots = hit.groupBy("sid", "ts").agg(agg("v").cast("double").alias("v"))
        dims = hit.groupBy("sid").agg(F.min("name").alias("name"))
        series = renumber(
            dims.select(
                "sid", F.lit(0).alias("ord"), "name", F.lit(pattern).alias("path_expr"), tags_of(F.col("name")).alias("tags"),
                F.lit(lo).cast("long").alias("start"), F.lit(hi).cast("long").alias("stop"), F.lit(self.step).cast("long").alias("step"),
                F.lit(self.cons_func).alias("cons_func"), F.lit(self.xff).cast("double").alias("xff"), empty_map().alias("opts"),
            ),
            *match_order(pattern, F.col("name")),
        )
        return SeriesFrame(series.select(*SERIES), dense(series, slots), self.step)

    def catalogue(self) -> DataFrame:
        names = self._slots(None, None).select("name").distinct()
        return names.select("name", F.split("name", ";")[0].alias("path"), tags_of(F.col("name")).alias("tags"), F.lit(self.step).cast("long").alias("step"), F.lit(self.cons_func).alias("cons_func"), F.lit(self.xff).cast("double").alias("xff"), F.lit(None).cast("long").alias("retention"))


class MemorySource:
    """Series given as Python rows; for tests and small reference data."""

    def __init__(self, spark: SparkSession, rows: list[dict]):
        self.spark, self.rows = spark, rows

    def scan(self, pattern: str, start: int, stop: int) -> SeriesFrame:
        rows = [r for r in self.rows if r["start"] < stop and r["start"] + len(r["values"]) * r["step"] > start]
        cut = []
        for r in rows:
            at = [i for i in range(len(r["values"])) if start <= r["start"] + i * r["step"] < stop]
            if at:
                cut.append(r | {"start": r["start"] + at[0] * r["step"], "values": [r["values"][i] for i in at]})
        if not cut:
            return SeriesFrame(self.spark.createDataFrame([], SERIES_DDL), self.spark.createDataFrame([], POINTS_DDL), 1)
        frame = frame_of(self.spark, cut)
        hit = frame.series.where(matches(pattern, F.col("name"), F.split("name", ";")[0], F.col("tags"))).withColumn("path_expr", F.lit(pattern))
        order = match_order(pattern, F.col("name"))[:-1]  # without globs, and of equal places, rows keep their order
        hit = renumber(hit, *order, F.col("ord")) if order else hit
        return SeriesFrame(hit, frame.points.join(hit.select("sid"), "sid", "left_semi"), frame.step)

    def catalogue(self) -> DataFrame:
        s = frame_of(self.spark, self.rows).series
        return s.select("name", F.split("name", ";")[0].alias("path"), "tags", "step", "cons_func", "xff", (F.col("stop") - F.col("start")).alias("retention"))


class UnionSource:
    """Several sources as one; lists are concatenated in their order."""

    def __init__(self, *sources: SeriesSource):
        self.sources = sources

    def scan(self, pattern: str, start: int, stop: int) -> SeriesFrame:
        from ..functions.setops import concat

        return concat([s.scan(pattern, start, stop) for s in self.sources])

    def catalogue(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.catalogue() for s in self.sources]).dropDuplicates(["name"])


__all__ = ["TAG_QUERY", "MemorySource", "SeriesSource", "TableSource", "UnionSource", "dense"]
