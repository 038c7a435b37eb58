"""Irregular readings brought onto a regular grid (problem 2).

The plan, in stages:

1. Readings are cut into blocks of `block_periods` periods per source, so that a
   source with a third of all rows is spread over its blocks. One exchange on
   (source, block) serves both the removal of repeated readings and the sums per
   period.
2. Each block's first and last reading is carried to its neighbours. Blocks are
   listed `block_periods` at a time, so that no window ever runs over a whole
   source's blocks: the carry is a tree of two levels, each smaller by that factor.
3. Sorted partitions stream into an as-of merge: a grid of periods against the
   block's readings, two binary searches giving each period its neighbours on
   both sides, then time-weighted linear interpolation.

Blocks that hold no reading are made from the gap between two that do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .responses import present

#: Times above this are milliseconds: as seconds they would lie after the year 5000.
MILLIS_FROM = 1e11


def clean_seconds(ts: Column) -> Column:
    """Epoch seconds as double; milliseconds are recognised by size. Null for absent, zero, negative or infinite times."""
    sec = F.when(F.abs(ts) >= F.lit(MILLIS_FROM), ts / F.lit(1000.0)).otherwise(ts)
    return F.when(ts.isNotNull() & ~F.isnan(ts) & (ts > 0) & (ts < F.lit(1e15)), sec)


def per_period(readings: DataFrame, targets: DataFrame, block_periods: int) -> DataFrame:
    """`target_id, step, block, slot, v, n, t0, v0, t1, v1`: each period that holds a present value.

    `slot` is the period's number since 1970; `v` the mean of its distinct
    readings; (t0, v0) and (t1, v1) its first and last reading. Readings repeated
    with the same time and value count once; of readings at one time with
    different values the mean counts.
    """
    steps = targets.where(F.col("target_id").isNotNull() & (F.col("step") > 0)).groupBy("target_id").agg(F.min("step").cast("long").alias("step"))
    clean = (
        readings.select("target_id", clean_seconds(F.col("ts")).alias("t"), "v")
        .where(F.col("t").isNotNull() & present(F.col("v")) & F.col("target_id").isNotNull())
        .join(steps, "target_id")
        .withColumn("slot", F.floor(F.col("t") / F.col("step")).cast("long"))
        .withColumn("block", F.floor(F.col("slot") / F.lit(block_periods)).cast("long"))
    )
    spread = clean.repartition("target_id", "block")
    once = spread.groupBy("target_id", "step", "block", "slot", "t", "v").agg(F.lit(1).alias("__one"))
    timed = once.groupBy("target_id", "step", "block", "slot", "t").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return timed.groupBy("target_id", "step", "block", "slot").agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"),
        F.sum("n").alias("n"),
        F.min("t").alias("t0"),
        F.min_by("v", "t").alias("v0"),
        F.max("t").alias("t1"),
        F.max_by("v", "t").alias("v1"),
    )


def _frames(edges: DataFrame, fan: int) -> DataFrame:
    """`target_id, step, block, t0, v0, t1, v1` of every block of the grid: the last reading before it and the first after it.

    Blocks are listed `fan` at a time; only the ends of these lists, smaller again
    by that factor, meet in a window over the source. Blocks without a reading
    follow the block before them.
    """
    one = F.struct("block", "t0", "v0", "t1", "v1")
    lists = edges.groupBy("target_id", "step", F.floor(F.col("block") / F.lit(fan)).cast("long").alias("over")).agg(F.sort_array(F.collect_list(one)).alias("bs"))
    w = Window.partitionBy("target_id").orderBy("over")
    linked = lists.select("target_id", "step", "bs", F.lag(F.element_at("bs", -1)).over(w).alias("far_last"), F.lead(F.col("bs")[0]).over(w).alias("far_first"))
    spot = linked.select("target_id", "step", "bs", "far_last", "far_first", F.posexplode("bs").alias("i", "b"))
    near = spot.select(
        "target_id", "step", "b",
        F.when(F.col("i") > 0, F.get("bs", F.col("i") - 1)).otherwise(F.col("far_last")).alias("before"),
        F.coalesce(F.get("bs", F.col("i") + 1), F.col("far_first")).alias("after"),
    )

    def frame(block: Column, left: str) -> Column:
        return F.struct(block.alias("block"), F.col(f"{left}.t1").alias("t0"), F.col(f"{left}.v1").alias("v0"), F.col("after.t0").alias("t1"), F.col("after.v0").alias("v1"))

    gap = F.when(F.col("after.block") > F.col("b.block") + 1, F.sequence(F.col("b.block") + 1, F.col("after.block") - 1)).otherwise(F.array().cast("array<bigint>"))
    every = F.concat(F.array(frame(F.col("b.block"), "before")), F.transform(gap, lambda k: frame(k, "b")))
    return near.select("target_id", "step", F.explode(every).alias("f")).select("target_id", "step", "f.*")


def regular_grid(
    readings: DataFrame,
    targets: DataFrame,
    max_gap_s: float | None = None,
    max_gap_periods: int = 10,
    block_periods: int = 4096,
) -> DataFrame:
    """One row per period of each source, from its first to its last with a present value.

    Columns `target_id long, slot_ts long, v double, how string, n long`:
    `how` is "observed" (v: the mean of the period's distinct readings),
    "interpolated" (v: the time-weighted line between the neighbours on both
    sides, taken at the middle of the period) or "gap" (v null: the neighbours
    are further apart than the limit). The limit is `max_gap_s` seconds or, where
    that is null, `max_gap_periods` periods.

    Absent values (null or NaN), null, zero or negative times and readings of
    unknown sources belong to no period; times in milliseconds are taken to
    seconds; a target listed twice has its smaller step; null or non-positive
    steps give nothing. An empty table gives an empty result. Infinite values are
    present; a line through one is infinite or NaN, and NaN is marked as a gap.
    """
    periods = per_period(readings, targets, block_periods)
    edges = periods.groupBy("target_id", "block").agg(
        F.min("step").alias("step"),
        F.min("t0").alias("t0"), F.min_by("v0", "t0").alias("v0"),
        F.max("t1").alias("t1"), F.max_by("v1", "t1").alias("v1"),
    )
    # each block is opened by its frame (slot -1), then come its periods
    frame = _frames(edges, block_periods).select("*", F.lit(-1).cast("long").alias("slot"), F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("n"))
    rows = periods.select("target_id", "step", "block", "slot", "v", "n", "t0", "v0", "t1", "v1").unionByName(frame)
    ordered = rows.repartition("target_id", "block").sortWithinPartitions("target_id", "block", "slot")
    limit_s, limit_n = (float(max_gap_s) if max_gap_s is not None else None), int(max_gap_periods)
    schema = T.StructType(
        [
            T.StructField("target_id", T.LongType()),
            T.StructField("slot_ts", T.LongType()),
            T.StructField("v", T.DoubleType()),
            T.StructField("how", T.StringType()),
            T.StructField("n", T.LongType()),
        ]
    )

    def merge(head: np.ndarray, body: dict[str, np.ndarray]) -> pd.DataFrame:
        target, step, block = int(head[0]), int(head[1]), int(head[2])
        bt, bv, at, av = head[3:]
        slot = body["slot"]
        lo = block * block_periods if not np.isnan(bt) else int(slot[0])
        hi = (block + 1) * block_periods if not np.isnan(at) else int(slot[-1]) + 1
        grid = np.arange(lo, hi, dtype=np.int64)
        # as-of on both sides: the last period with a reading before each grid period, the first after it
        right = np.searchsorted(slot, grid, side="left")
        seen = np.zeros(len(grid), bool)
        if len(slot):
            seen = slot[np.minimum(right, len(slot) - 1)] == grid
        n = np.zeros(len(grid), np.int64)
        v = np.full(len(grid), np.nan)
        v[seen], n[seen] = body["v"], body["n"]
        lt, lv = np.concatenate(([bt], body["t1"])), np.concatenate(([bv], body["v1"]))
        rt, rv = np.concatenate((body["t0"], [at])), np.concatenate((body["v0"], [av]))
        hole = ~seen
        k = right[hole]
        t, ta, tb, va, vb = (grid[hole] + 0.5) * step, lt[k], rt[k], lv[k], rv[k]
        with np.errstate(all="ignore"):
            line = va + (vb - va) * ((t - ta) / (tb - ta))
        within = (tb - ta) <= (limit_s if limit_s is not None else limit_n * step)
        line[~within] = np.nan
        v[hole] = line
        how = np.full(len(grid), "observed", dtype=object)
        how[hole] = np.where(np.isnan(line), "gap", "interpolated")
        return pd.DataFrame({"target_id": np.full(len(grid), target), "slot_ts": grid * step, "v": v, "how": how, "n": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            # every block begins with its frame row (slot -1); the last block of a batch may go on in the next
            starts = np.flatnonzero(pdf["slot"].to_numpy() == -1)
            if not len(starts):
                kept.append(pdf)
                continue
            done = pd.concat([*kept, pdf.iloc[: starts[-1]]]) if kept else pdf.iloc[: starts[-1]]
            kept = [pdf.iloc[starts[-1] :]]
            if len(done):
                yield from blocks(done)
        if kept:
            yield from blocks(pd.concat(kept))

    def blocks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        slot = pdf["slot"].to_numpy()
        heads = pdf[["target_id", "step", "block", "t0", "v0", "t1", "v1"]].to_numpy(dtype=float)
        body = {c: pdf[c].to_numpy() for c in ("slot", "v", "n", "t0", "v0", "t1", "v1")}
        starts = np.append(np.flatnonzero(slot == -1), len(slot))
        out, size = [], 0
        for a, b in zip(starts[:-1], starts[1:]):
            out.append(merge(heads[a], {c: x[a + 1 : b] for c, x in body.items()}))
            size += len(out[-1])
            if size > 50_000:
                yield pd.concat(out)
                out, size = [], 0
        if out:
            yield pd.concat(out)

    ship(ordered.sparkSession)
    merged = ordered.mapInPandas(run, schema)
    return merged.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def empty_periods(grid: DataFrame) -> DataFrame:
    """`target_id long, slot_ts long`: the periods of regular_grid() that hold no present value."""
    return grid.where(F.col("how") != "observed").select("target_id", "slot_ts")
