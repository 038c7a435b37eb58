"""Steps: one for all series of a list, and fewer points for display."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..model import SeriesFrame
from .aggs import consolidate


def lcm_step(frame: SeriesFrame) -> int:
    """The least common multiple of the steps; they are few and come from the small series table."""
    if frame.step is not None:
        return frame.step
    steps = [int(r[0]) for r in frame.series.select("step").distinct().collect() if r[0]]
    return math.lcm(*steps) if steps else 1


def _facts(frame: SeriesFrame) -> tuple[set[int], set[str]]:
    """The steps and the consolidation functions of a list: few, from the small series table, in one question."""
    rows = frame.series.select("step", "cons_func").distinct().collect()
    return {int(r[0]) for r in rows if r[0]}, {r[1] for r in rows if r[1]}


def to_step(frame: SeriesFrame, step: int, used: set[str] | None = None) -> SeriesFrame:
    """Values merged into slots of `step` seconds by each series' own consolidation function and xFilesFactor.

    Slots lie on multiples of the step. A slot is absent where its share of
    present values is below the factor (0: no test).
    """
    meta = frame.series.select("sid", "cons_func", "xff", F.col("step").alias("__own"))
    slot = (F.col("ts") - F.pmod(F.col("ts"), F.lit(step))).alias("ts")
    got = frame.points.join(meta, "sid").select("sid", slot, F.col("ts").alias("at"), "v", "cons_func", "xff", "__own")
    per = F.lit(step) / F.max("__own")
    value = consolidate(F.col("v"), F.col("at"), F.col("cons_func"), _facts(frame)[1] if used is None else used)
    points = got.groupBy("sid", "ts").agg(F.when((F.max("xff") == 0) | (F.count("v") / per >= F.max("xff")), value).alias("v"))
    start = F.col("start") - F.pmod(F.col("start"), F.lit(step))
    stop = F.ceil(F.col("stop") / F.lit(step)).cast("long") * F.lit(step)
    series = frame.series.withColumns({"start": start, "stop": stop, "step": F.lit(step).cast("long")})
    return SeriesFrame(series, points, step)


def common(frame: SeriesFrame) -> SeriesFrame:
    """The list with one step; nothing is read or moved where it has one already."""
    if frame.step is not None:
        return frame
    steps, used = _facts(frame)
    return to_step(frame, math.lcm(*steps) if steps else 1, used)


#: The steps a source is asked for, in seconds (fixed values).
STEPS = (20, 30, 60, 120, 300, 600, 900, 1200, 1800, 3600, 7200, 10800, 21600, 43200, 86400)


def choose_step(start: int, stop: int, most: int, least: int, keep_least_within: int = 0) -> int:
    """A step for a range that gives `most` points at most, from the usual ones; never below `least`.

    Ranges shorter than `keep_least_within` seconds keep the least step; very long
    ones get a day.
    """
    span = stop - start
    want = max(least, -(-span // most))
    if span < keep_least_within or want <= least:
        return least
    return next((s for s in STEPS if want <= s), STEPS[-1])


def max_points(frame: SeriesFrame, most: int, nudge: bool = False, stamp_last: bool = False) -> SeriesFrame:
    """At most `most` points per series: blocks of neighbours merged by each series' consolidation function.

    With `nudge` leading points are left out so that blocks begin one step after
    multiples of their size, whatever the range; series of two blocks or less keep
    them. With `stamp_last` a block has the time of its last point.
    """
    span = frame.series.agg(F.min("start").alias("a"), F.max("stop").alias("b")).first()
    if most <= 0 or span is None or span["a"] is None:
        return frame
    whole = int(span["b"]) - int(span["a"])
    p = F.floor(F.lit(whole) / F.col("step"))
    vpp = F.when(p > most, F.ceil(p / F.lit(most))).otherwise(F.lit(1)).cast("long")
    dims = frame.series.select("sid", "start", "stop", "step", "cons_func", vpp.alias("vpp")).withColumn("size", F.col("vpp") * F.col("step"))
    left = F.pmod(F.col("size") - F.pmod(F.col("start") - F.col("step"), F.col("size")), F.col("size"))
    long_enough = (F.col("stop") - F.col("start")) / F.col("step") > 2 * F.col("vpp")
    skip = F.when(F.lit(nudge) & long_enough, F.floor(left / F.col("step")) * F.col("step")).otherwise(0).cast("long")
    dims = dims.withColumn("begin", F.col("start") + skip).drop("start", "stop")
    got = frame.points.join(dims, "sid").where(F.col("ts") >= F.col("begin"))
    slot = (F.col("begin") + F.floor((F.col("ts") - F.col("begin")) / F.col("size")).cast("long") * F.col("size")).alias("slot")
    value = consolidate(F.col("v"), F.col("ts"), F.col("cons_func"), _facts(frame)[1])
    merged = got.select("sid", slot, "ts", "v", "cons_func").groupBy("sid", "slot").agg(value.alias("v"), F.max("ts").alias("last"))
    points = merged.select("sid", (F.col("last") if stamp_last else F.col("slot")).alias("ts"), "v")
    series = frame.series.join(dims.select("sid", "begin", "size"), "sid").withColumns({"start": F.col("begin"), "step": F.col("size")}).drop("begin", "size")
    return SeriesFrame(series, points, None)
