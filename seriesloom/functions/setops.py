"""Lists put together, and set operations on lists by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SeriesFrame, renumber
from .registry import FAILURES, Args, EvalError, register


def concat(frames: list[SeriesFrame]) -> SeriesFrame:
    """The lists one after the other. A series that is in several lists is in the result as often."""
    if len(frames) == 1:
        return frames[0]
    series, points = [], []
    for i, f in enumerate(frames):
        new = F.xxhash64(F.col("sid"), F.lit(i)).alias("sid")
        series.append(f.series.select(new, F.lit(i).alias("__list"), *[c for c in f.series.columns if c != "sid"]))
        points.append(f.points.select(new, "ts", "v"))
    steps = {f.step for f in frames}
    both = renumber(reduce(DataFrame.unionByName, series), F.col("__list"), F.col("ord")).drop("__list")
    return SeriesFrame(both, reduce(DataFrame.unionByName, points), steps.pop() if len(steps) == 1 else None)


@register("group", group="Combine", args="*seriesLists")
def group(ctx, a: Args) -> SeriesFrame:
    """All arguments as one list."""
    return a.all_series()


@register("join", group="Combine", args="seriesA, seriesB, type='AND'")
def join(ctx, a: Args) -> SeriesFrame:
    """Set operations by series name: AND, OR, XOR, SUB. What repeats within a side is kept."""
    left, right = a.series(0), a.series(1)
    how = a.string(2, "type", "AND").upper()
    names_l, names_r = left.series.select("name").distinct(), right.series.select("name").distinct()

    def only(f: SeriesFrame, names: DataFrame, kind: str) -> SeriesFrame:
        return f.keep(f.series.join(names, "name", kind))

    if how == "AND":
        return only(left, names_r, "left_semi")
    if how == "SUB":
        return only(left, names_r, "left_anti")
    if how == "OR":
        return concat([left, only(right, names_l, "left_anti")])
    if how == "XOR":
        return concat([only(left, names_r, "left_anti"), only(right, names_l, "left_anti")])
    raise EvalError(f"join: unknown type {how}")


@register("fallbackSeries", group="Filter Series", args="seriesList, fallback")
def fallback_series(ctx, a: Args) -> SeriesFrame:
    """The first list, or the second where the first has no series or cannot be read."""
    second = a.series(1)
    try:
        first = a.series(0)
    except FAILURES:
        return second
    # one row says whether the first list is empty; the second list's rows pass an anti join on it
    flag = first.series.limit(1).select(F.lit(1).alias("__k"))
    if_empty = second.series.withColumn("__k", F.lit(1)).join(flag, "__k", "left_anti").drop("__k")
    return concat([first, second.keep(if_empty)])
