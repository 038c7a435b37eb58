"""Frames over the points of a series.

A window of n points looks back: the argument is read from n steps earlier and
the points before the range are dropped again. Long windows of associative
aggregates are put together from two parts, so that a point costs the same
whatever the window is; the rest are framed aggregates. Nothing is ever
subtracted: what leaves a window leaves no trace, be it infinite or very large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang import times
from ..model import SeriesFrame, V, absent_nan, by_series, past
from . import align
from .registry import Args, EvalError, register

#: Windows of more points than this are put together from two parts; the results are the same.
LONG = 256
_PAIRED = ("sum", "total", "avg", "average", "avg_zero", "count", "min", "max", "range", "rangeOf")


def _framed(name: str, w: Window) -> Column:
    table = {
        "avg": lambda: F.avg("v").over(w),
        "sum": lambda: F.sum("v").over(w),
        "min": lambda: F.min("v").over(w),
        "max": lambda: F.max("v").over(w),
        "count": lambda: F.when(F.count("v").over(w) > 0, F.count("v").over(w).cast("double")),
        "stddev": lambda: F.stddev_pop("v").over(w),
        "range": lambda: F.max("v").over(w) - F.min("v").over(w),
        "median": lambda: F.percentile("v", F.lit(0.5)).over(w),
        "multiply": lambda: F.when(F.count("v").over(w) == F.count(F.lit(1)).over(w), F.product("v").over(w)),
        "diff": lambda: F.when(F.first("v").over(w).isNotNull(), 2 * F.first("v").over(w) - F.sum("v").over(w)),
        "last": lambda: F.last("v").over(w),
    }
    table |= {"average": table["avg"], "avg_zero": lambda: F.sum("v").over(w) / F.count(F.lit(1)).over(w), "total": table["sum"], "rangeOf": table["range"]}
    if name not in table:
        raise EvalError(f"movingWindow: unsupported function {name}")
    return table[name]()


def _paired(f: SeriesFrame, n: int, name: str) -> DataFrame:
    """`sid, ts, v, c`: an aggregate of the last n points, and how many of them are present.

    Points are cut into blocks of n. A window is the end of one block and the
    beginning of the next, so two running aggregates within blocks, one forwards
    and one backwards, give every window.
    """
    parts = {"sum": F.sum, "count": F.count, "low": F.min, "high": F.max, "rows": lambda _: F.count(F.lit(1))}
    wanted = {"sum": ("sum",), "total": ("sum",), "avg": ("sum",), "average": ("sum",), "avg_zero": ("sum", "rows"), "min": ("low",), "max": ("high",)}.get(name, () if name == "count" else ("low", "high"))
    used = ["count", *wanted]
    placed = f.points.select("sid", "ts", "v", (F.row_number().over(by_series()) - 1).alias("i"))
    placed = placed.withColumn("block", F.floor(F.col("i") / F.lit(n)))
    block = Window.partitionBy("sid", "block")
    to_here = block.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    from_here = block.orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("sid", "ts", "i", *(parts[k]("v").over(to_here).alias(k) for k in used), *(parts[k]("v").over(from_here).alias(f"end_{k}") for k in used))
    # the window begins within the block before, unless it is a whole block
    lead = F.when(F.pmod("i", F.lit(n)) != n - 1, F.lag(F.struct(*(f"end_{k}" for k in used)), n - 1).over(by_series()))
    met = run.select("sid", "ts", *used, lead.alias("lead"))
    merge = {"low": F.least, "high": F.greatest}

    def both(k: str) -> Column:
        other = F.col(f"lead.end_{k}")
        if k in merge:
            return merge[k](F.col(k), other)  # nulls are skipped
        return F.coalesce(F.col(k) + other, F.col(k), other)

    count = F.coalesce(both("count"), F.lit(0))
    value = {
        "sum": lambda: both("sum"), "total": lambda: both("sum"), "avg": lambda: both("sum") / count, "average": lambda: both("sum") / count, "avg_zero": lambda: both("sum") / both("rows"),
        "count": lambda: count.cast("double"), "min": lambda: both("low"), "max": lambda: both("high"), "range": lambda: both("high") - both("low"), "rangeOf": lambda: both("high") - both("low"),
    }[name]()
    return met.select("sid", "ts", F.when(count > 0, value).alias("v"), count.alias("c"))


def window_of(a: Args, i: int) -> tuple[int | None, int | None, str]:
    """A window in points or in seconds, and how it is shown."""
    if a.is_string(i, "windowSize"):
        text = a.string(i, "windowSize")
        return None, abs(times.interval(text, 1)), f"'{text}'"
    n = a.integer(i, "windowSize")
    if n < 1:
        raise EvalError(f"{a.fn}: the window has no points")
    return n, None, str(n)


def look_back(ctx, a: Args, points: int | None, seconds: int | None) -> SeriesFrame:
    """The argument from a window earlier on; a window in points asks for the step first."""
    if seconds is None:
        seconds = points * a.series(0).common_step()
    return a.series(0, ctx.start - seconds, ctx.stop)


def trim(ctx, f: SeriesFrame) -> SeriesFrame:
    """Without the points before the request's range."""
    start = F.greatest(F.col("start"), F.ceil(F.lit(ctx.start) / F.col("step")).cast("long") * F.col("step"))
    return f.with_points(f.points.where(F.col("ts") >= ctx.start)).with_series(f.series.withColumn("start", start))


def _moving(ctx, a: Args, func: str, xff_at: int) -> SeriesFrame:
    n, seconds, shown = window_of(a, 1)
    xff = a.number(xff_at, "xFilesFactor", 0.0)
    f = align.common(look_back(ctx, a, n, seconds))
    step = f.common_step()
    if n is None:
        n = seconds // step
    if n < 1:  # the window is shorter than a step
        return trim(ctx, f.map(F.lit(None).cast("double"))).call(a.fn, shown)
    if n > LONG and func in _PAIRED:
        rows = _paired(f, n, func)
        v = F.when(F.col("c") / F.lit(n) >= xff, V()) if xff else V()
        out = f.with_points(rows.select("sid", "ts", absent_nan(v).alias("v")))
    else:
        w = past(n)
        value = F.when(F.count("v").over(w) > 0, _framed(func, w))
        if xff:
            value = F.when(F.count("v").over(w) / F.lit(n) >= xff, value)
        out = f.with_points(f.points.select("sid", "ts", absent_nan(value).alias("v")))
    return trim(ctx, out).call(a.fn, shown)


def _register(name: str, func: str) -> None:
    def build(ctx, a: Args) -> SeriesFrame:
        return _moving(ctx, a, func, 2)

    build.__doc__ = f"The {func} of the window that ends with each point."
    register(name, group="Calculate", args="seriesList, windowSize, xFilesFactor=None")(build)


for _n, _f in (("movingAverage", "average"), ("movingMin", "min"), ("movingMax", "max"), ("movingSum", "sum")):
    _register(_n, _f)


@register("movingWindow", group="Calculate", args="seriesList, windowSize, func='average', xFilesFactor=None")
def moving_window(ctx, a: Args) -> SeriesFrame:
    """Any aggregate of the window that ends with each point."""
    return _moving(ctx, a, a.string(2, "func", "average"), 3)


@register("movingMedian", group="Calculate", args="seriesList, windowSize, xFilesFactor=None")
def moving_median(ctx, a: Args) -> SeriesFrame:
    """The median of the window; a window in points does not look back, so the first points are absent."""
    n, seconds, shown = window_of(a, 1)
    f = align.common(a.series(0) if seconds is None else look_back(ctx, a, None, seconds))
    whole = n is not None
    n = n or max(1, seconds // f.common_step())
    w = past(n)
    value = F.percentile("v", F.lit(0.5)).over(w)
    if whole:
        value = F.when(F.count(F.lit(1)).over(w) == n, value)
    return trim(ctx, f.with_points(f.points.select("sid", "ts", value.alias("v")))).call(a.fn, shown)


@register("stdev", group="Calculate", args="seriesList, points, windowTolerance=0.1")
def stdev(ctx, a: Args) -> SeriesFrame:
    """The population deviation of the last `points` points, where the point is present and enough others are."""
    f, n, tolerance = a.series(0), a.integer(1, "points"), a.number(2, "windowTolerance", 0.1)
    least = int((1 - tolerance) * n)
    w = past(n)
    i = F.row_number().over(by_series()) - 1
    enough = ~((i >= least) & (F.count("v").over(w) < least))
    points = f.points.select("sid", "ts", F.when(V().isNotNull() & enough, F.stddev_pop("v").over(w)).alias("v"))
    return f.with_points(points).call(a.fn, str(n))


def _pair(a: Args) -> tuple[SeriesFrame, SeriesFrame]:
    """Two single series on one step."""
    left, right = a.series(0), a.series(1)
    for i, f in enumerate((left, right)):
        if f.series.limit(2).count() != 1:
            raise EvalError(f"{a.fn}: argument {i + 1} must be one series")
    return left, right


def pair_points(left: SeriesFrame, right: SeriesFrame):
    b = right.points.select("ts", F.col("v").alias("b"))
    return left.points.select("sid", "ts", F.col("v").alias("a")).join(b, "ts")


@register("pearson", group="Calculate", args="seriesList, seriesList, windowSize")
def pearson(ctx, a: Args) -> SeriesFrame:
    """The correlation of two series over the last n points."""
    n = a.integer(2, "windowSize")
    left, right = _pair(a)
    w = past(n)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    x, y = F.when(both, F.col("a")), F.when(both, F.col("b"))
    rows = pair_points(left, right).select("sid", "ts", x.alias("a"), y.alias("b"))
    # a flat side has no correlation
    r = F.when((F.count(F.lit(1)).over(w) == n) & (F.stddev_pop("a").over(w) > 0) & (F.stddev_pop("b").over(w) > 0), F.corr("a", "b").over(w))
    return left.with_points(rows.select("sid", "ts", F.nanvl(r, F.lit(None)).alias("v"))).rename(F.lit(f"pearson({a.node.args[0].text},{a.node.args[1].text},{n})"))


__all__ = ["look_back", "pair_points", "trim", "window_of"]
