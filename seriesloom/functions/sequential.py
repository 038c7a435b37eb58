"""Along one series in time, by window functions over (sid, ts)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import SeriesFrame, V, by_series, past
from .registry import Args, EvalError, fmt, register



def _before():
    return by_series().rowsBetween(Window.unboundedPreceding, -1)


@register("derivative", group="Transform")
def derivative(ctx, a: Args) -> SeriesFrame:
    """The value minus the last present one before it."""
    f = a.series(0)
    return f.with_points(f.points.select("sid", "ts", (V() - F.last("v", True).over(_before())).alias("v"))).call(a.fn)


def _counter(f: SeriesFrame, top: float | None, low: float | None) -> SeriesFrame:
    if top is not None and low is None:
        low = 0.0
    if top is not None and top <= low:
        raise EvalError("maxValue must be above minValue")
    rows = f.points.select("sid", "ts", "v", F.lag("v", 1).over(by_series()).alias("p"))
    d = V() - F.col("p")
    out = F.when(d >= 0, d)
    if top is not None:
        out = out.when(d.isNotNull() & (V() <= top), F.lit(top) - F.col("p") + V() - F.lit(low) + 1)
    elif low is not None:
        out = out.when(d.isNotNull() & (V() >= low), V() - F.lit(low))
    return f.with_points(rows.select("sid", "ts", out.alias("v")))


def _limits(a: Args) -> tuple[float | None, float | None, list[str]]:
    top, low = a.number(1, "maxValue", None), a.number(2, "minValue", None)
    return top, low, [fmt(x) for x in (top, low) if x is not None]


@register("nonNegativeDerivative", group="Transform", args="seriesList, maxValue=None, minValue=None")
def non_negative_derivative(ctx, a: Args) -> SeriesFrame:
    """The growth of a counter since the slot before; absent where it fell, but for a wrap at maxValue."""
    top, low, shown = _limits(a)
    return _counter(a.series(0), top, low).call(a.fn, *shown)


@register("perSecond", group="Transform", args="seriesList, maxValue=None, minValue=None")
def per_second(ctx, a: Args) -> SeriesFrame:
    """The growth of a counter per second."""
    top, low, shown = _limits(a)
    f = _counter(a.series(0), top, low)
    points = f.points.select("sid", "ts", (V() / f.step).alias("v")) if f.step else f.joined("step").select("sid", "ts", (V() / F.col("step")).alias("v"))
    return f.with_points(points).call(a.fn, *shown)


@register("integral", group="Transform")
def integral(ctx, a: Args) -> SeriesFrame:
    """The running sum; absent stays absent."""
    f = a.series(0)
    return f.with_points(f.points.select("sid", "ts", F.when(V().isNotNull(), F.sum("v").over(past())).alias("v"))).call(a.fn)


@register("integralByInterval", group="Transform", args="seriesList, intervalUnit")
def integral_by_interval(ctx, a: Args) -> SeriesFrame:
    """The running sum, begun anew each interval from the request's start; absent counts as 0."""
    f, b = a.series(0), a.seconds(1, "intervalUnit")
    k = F.floor((F.col("ts") - F.lit(ctx.start)) / F.lit(b))
    w = Window.partitionBy("sid", "k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = f.points.select("sid", "ts", F.coalesce(V(), F.lit(0.0)).alias("v"), k.alias("k"))
    return f.with_points(rows.select("sid", "ts", F.sum("v").over(w).alias("v"))).call(a.fn, f"'{a.string(1, 'intervalUnit')}'")


@register("integralWithReset", group="Transform", args="seriesList, resettingSeries")
def integral_with_reset(ctx, a: Args) -> SeriesFrame:
    """The running sum, begun anew at 0 where the one resetting series is present and not 0."""
    f, r = a.series(0), a.series(1)
    resets = r.points.where(V().isNotNull() & (V() != 0)).select("ts").distinct().withColumn("reset", F.lit(1))
    rows = f.points.join(resets, "ts", "left").withColumn("seg", F.count("reset").over(past()))
    w = Window.partitionBy("sid", "seg").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    summed = F.sum(F.when(F.col("reset").isNull(), V()).otherwise(0.0)).over(w)
    return f.with_points(rows.select("sid", "ts", F.when(F.col("reset").isNotNull(), F.lit(0.0)).when(V().isNotNull(), summed).alias("v"))).call(a.fn, a.node.args[1].text)


@register("changed", group="Special")
def changed(ctx, a: Args) -> SeriesFrame:
    """1 where a present value differs from the present one before it, else 0."""
    f = a.series(0)
    p = F.last("v", True).over(_before())
    return f.with_points(f.points.select("sid", "ts", F.coalesce((V() != p).cast("double"), F.lit(0.0)).alias("v"))).call(a.fn)


def _gaps(f: SeriesFrame):
    """Each point with the number of present values up to it (its stretch) and its place in the stretch (0: present)."""
    rows = f.points.withColumn("g", F.count("v").over(past()))
    w = Window.partitionBy("sid", "g").orderBy("ts")
    return rows.withColumn("i", F.row_number().over(w) - F.when(F.col("g") > 0, 1).otherwise(0))


@register("keepLastValue", group="Transform", args="seriesList, limit=inf")
def keep_last_value(ctx, a: Args) -> SeriesFrame:
    """The last present value in gaps, for `limit` points of each gap at most."""
    f, limit = a.series(0), a.number(1, "limit", float("inf"))
    if limit < 0 or limit == float("inf"):
        points = f.points.select("sid", "ts", F.last("v", True).over(past()).alias("v"))
    else:
        w = Window.partitionBy("sid", "g").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        points = _gaps(f).select("sid", "ts", F.when(F.col("i") <= int(limit), F.first("v").over(w)).alias("v"))
    return f.with_points(points).call(a.fn, *([fmt(limit)] if a.get(1, "limit") else []))


@register("interpolate", group="Transform", args="seriesList, limit=inf")
def interpolate(ctx, a: Args) -> SeriesFrame:
    """A straight line through gaps between present values that are no longer than `limit` points."""
    f, limit = a.series(0), a.number(1, "limit", float("inf"))
    stretch = Window.partitionBy("sid", "g")
    # the present value that ends a stretch opens the next one: one row per stretch meets its successor
    rows = _gaps(f).withColumn("size", F.max("i").over(stretch))
    heads = rows.where(V().isNotNull()).select("sid", "g", F.col("v").alias("a"), F.lead("v").over(Window.partitionBy("sid").orderBy("g")).alias("b"))
    met = rows.join(heads, ["sid", "g"], "left")
    line = F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (F.col("size") + 1)
    fits = F.col("size") <= (int(limit) if limit not in (float("inf"),) else 2**31 - 1)
    return f.with_points(met.select("sid", "ts", F.coalesce(V(), F.when(fits, line)).alias("v"))).call(a.fn, *([fmt(limit)] if a.get(1, "limit") else []))


@register("compressPeriodicGaps", group="Transform")
def compress_periodic_gaps(ctx, a: Args) -> SeriesFrame:
    """A series that is present only every n-th slot, with a step of n slots.

    The period is the distance of the first two present values; it holds if a
    third follows at the same distance, with absent neighbours. Other series stay.
    """
    f = a.series(0)
    rows = f.points.select("sid", "ts", "v", (F.row_number().over(by_series()) - 1).alias("i"), F.lag("v").over(by_series()).alias("p"), F.lead("v").over(by_series()).alias("x"))
    seen = rows.where(V().isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("sid").orderBy("i")))
    two = seen.where("k <= 2").groupBy("sid").agg(F.min("i").alias("i1"), F.max("i").alias("i2"), F.count(F.lit(1)).alias("c")).where("c = 2").withColumn("g", F.expr("i2 - i1"))
    size = rows.groupBy("sid").agg((F.max("i") + 1).alias("n"))
    third = rows.join(two.join(size, "sid"), "sid").where((F.col("i") == F.col("i2") + F.col("g")) & (F.col("g") > 1) & (F.col("i") <= F.col("n") - 2) & V().isNotNull() & F.col("p").isNull() & F.col("x").isNull())
    periods = third.select("sid", "g", "i1")
    met = rows.join(periods, "sid", "left").join(f.series.select("sid", "start", "step"), "sid")
    first = F.col("start") + F.col("i1") * F.col("step")
    size_s = F.col("g") * F.col("step")
    slot = F.when(F.col("g").isNull(), F.col("ts")).otherwise(first + F.floor((F.col("ts") - first) / size_s).cast("long") * size_s)
    points = (
        met.where(F.col("g").isNull() | (F.col("i") >= F.col("i1")))
        .select("sid", slot.alias("slot"), "ts", "v")
        .groupBy("sid", F.col("slot"))
        .agg(F.max_by("v", F.when(V().isNotNull(), F.col("ts"))).alias("v"))
        .select("sid", F.col("slot").alias("ts"), "v")
    )
    series = f.series.join(periods, "sid", "left").withColumn("start", F.col("start") + F.coalesce(F.col("i1"), F.lit(0)) * F.col("step")).withColumn("step", F.col("step") * F.coalesce("g", F.lit(1))).drop("g", "i1")
    return SeriesFrame(series.select(*f.series.columns), points, None).call(a.fn)


@register("cumulative", group="Special")
def cumulative(ctx, a: Args) -> SeriesFrame:
    """Sums where points are merged for display; values stay."""
    f = a.series(0)
    return f.with_series(f.series.withColumn("cons_func", F.lit("sum"))).call("consolidateBy", '"sum"')
