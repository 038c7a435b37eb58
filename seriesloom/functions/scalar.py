"""Point by point: one value in, one value out, all in one projection."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..lang import times
from ..model import SeriesFrame, V, by_series
from .registry import Args, EvalError, fmt, register



def _simple(names: tuple[str, ...], make, doc: str, show: str | None = None):
    def build(ctx, a: Args) -> SeriesFrame:
        return a.series(0).map(make(V())).call(show or a.fn)

    build.__doc__ = doc
    register(*names, group="Transform")(build)


_simple(("absolute",), F.abs, "The absolute value.")
_simple(("invert",), lambda v: F.try_divide(F.lit(1.0), v), "1/v; absent for 0.")
_simple(("squareRoot",), lambda v: F.when(v >= 0, F.sqrt(v)), "The square root; absent for negative values.")
_simple(("exp",), F.exp, "e to the power of the value.")
_simple(("logit",), lambda v: F.when((v > 0) & (v < 1), F.ln(v / (1 - v))).when(v == 0, F.lit(float("-inf"))), "ln(v/(1-v)); absent for 1 and outside 0..1.")
_simple(("sigmoid",), lambda v: 1 / (1 + F.exp(-v)), "1/(1+e^-v).")
_simple(("isNotNull", "isNonNull"), lambda v: v.isNotNull().cast("double"), "1 where a value is present, else 0.", "isNonNull")


@register("add", "offset", group="Transform", args="seriesList, constant")
def add(ctx, a: Args) -> SeriesFrame:
    """The value plus a constant."""
    c = a.number(1, "constant" if a.fn == "add" else "factor")
    return a.series(0).map(V() + F.lit(c)).call(a.fn, fmt(c))


@register("scale", "scaleAfterTimestamp", group="Transform", args="seriesList, factor, timestamp=0")
def scale(ctx, a: Args) -> SeriesFrame:
    """The value times a factor, from a time on where one is given."""
    f, t0 = a.number(1, "factor"), a.integer(2, "timestamp", 0)
    out = a.series(0).map(F.when(F.col("ts") >= t0, V() * F.lit(f)).otherwise(V()) if t0 else V() * F.lit(f))
    return out.call(a.fn, fmt(f), *([str(t0)] if t0 else []))


@register("scaleToSeconds", group="Transform", args="seriesList, seconds")
def scale_to_seconds(ctx, a: Args) -> SeriesFrame:
    """Values per step as values per a number of seconds."""
    s, frame = a.number(1, "seconds"), a.series(0)
    if frame.step:
        return frame.map(V() * F.lit(s / frame.step)).call(a.fn, fmt(s))
    points = frame.joined("step").select("sid", "ts", (V() * F.lit(s) / F.col("step")).alias("v"))
    return frame.with_points(points).call(a.fn, fmt(s))


@register("pow", group="Transform", args="seriesList, factor")
def power(ctx, a: Args) -> SeriesFrame:
    """The value to a power; absent stays absent."""
    p = a.number(1, "factor")
    return a.series(0).map(F.pow(V(), F.lit(p))).call(a.fn, fmt(p))


@register("logarithm", "log", group="Transform", args="seriesList, base=10")
def logarithm(ctx, a: Args) -> SeriesFrame:
    """The logarithm to a base; -infinity for 0, absent below."""
    base = a.number(1, "base", 10.0)
    if base <= 0 or base == 1:
        raise EvalError("log: the base is positive and not 1")
    out = F.when(V() > 0, F.ln(V()) / F.lit(math.log(base))).when(V() == 0, F.lit(float("-inf") if base > 1 else float("inf")))
    return a.series(0).map(out).call("logarithm", *([fmt(base)] if base != 10 else []))


@register("round", group="Transform", args="seriesList, precision=0")
def round_(ctx, a: Args) -> SeriesFrame:
    """Rounded to a number of decimals, halves to the even neighbour."""
    p = a.integer(1, "precision", 0)
    k = F.lit(10.0**p)
    # rint rounds halves of the binary value to even, as the language does
    return a.series(0).map(F.rint(V() * k) / k).call(a.fn, *([str(p)] if len(a) > 1 or a.node.named else []))


@register("transformNull", group="Transform", args="seriesList, default=0, referenceSeries=None")
def transform_null(ctx, a: Args) -> SeriesFrame:
    """Absent values as a default; only where a reference series is present, if one is named."""
    d = a.number(1, "default", 0.0)
    frame = a.series(0)
    ref = a.node.named.get("referenceSeries")
    if ref is None:
        out = frame.map(F.coalesce(V(), F.lit(d)))
    else:
        seen = ctx.eval(ref).points.where(V().isNotNull()).select("ts").distinct().withColumn("__r", F.lit(True))
        points = frame.points.join(seen, "ts", "left").select("sid", "ts", F.when(F.col("__r"), F.coalesce(V(), F.lit(d))).otherwise(V()).alias("v"))
        out = frame.with_points(points)
    out = out.call(a.fn, *([fmt(d)] if a.get(1, "default") else []))
    if a.boolean(3, "defaultOnAbsent", False):
        from ..model import frame_of
        from .setops import concat

        line = frame_of(ctx.spark, [{"name": a.node.args[0].text, "start": ctx.start, "step": max(1, ctx.stop - ctx.start), "values": [d, d]}])
        none = out.series.limit(1).select(F.lit(1).alias("__k"))
        line = line.keep(line.series.withColumn("__k", F.lit(1)).join(none, "__k", "left_anti"))
        return concat([out, line])
    return out


def _extremes(frame: SeriesFrame):
    w = Window.partitionBy("sid")
    return frame.points.select("sid", "ts", "v", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))


@register("offsetToZero", group="Transform")
def offset_to_zero(ctx, a: Args) -> SeriesFrame:
    """The value minus the series' minimum."""
    frame = a.series(0)
    return frame.with_points(_extremes(frame).select("sid", "ts", (V() - F.col("lo")).alias("v"))).call(a.fn)


@register("minMax", group="Transform")
def min_max(ctx, a: Args) -> SeriesFrame:
    """The value scaled to the series' range, 0..1; 0 where the range is empty."""
    frame = a.series(0)
    span = F.col("hi") - F.col("lo")
    out = F.when(V().isNotNull(), F.when(span == 0, F.lit(0.0)).otherwise((V() - F.col("lo")) / span))
    return frame.with_points(_extremes(frame).select("sid", "ts", out.alias("v"))).call(a.fn)


@register("lowPass", "lpf", group="Filter Data", args="seriesList, cutPercent")
def low_pass(ctx, a: Args) -> SeriesFrame:
    """Keeps the first and last cutPercent/2 percent of the points; what lies between becomes absent."""
    pct, frame = a.number(1, "cutPercent"), a.series(0)
    n = F.count(F.lit(1)).over(Window.partitionBy("sid"))
    rows = frame.points.select("sid", "ts", "v", (F.row_number().over(by_series()) - 1).alias("i"), n.alias("n"))
    cut = F.floor(F.lit(pct / 200.0) * F.col("n"))
    points = rows.select("sid", "ts", F.when((F.col("i") < cut) | (F.col("i") >= F.col("n") - cut), V()).alias("v"))
    return frame.with_points(points).call(a.fn, fmt(pct))


@register("timeSlice", group="Filter Data", args="seriesList, startSliceAt, endSliceAt='now'")
def time_slice(ctx, a: Args) -> SeriesFrame:
    """Absent outside a period."""

    def when(i: int, name: str, default: str) -> int:
        text = a.string(i, name, default)
        try:
            return times.at_time(text, ctx.now)
        except ValueError:
            return ctx.now + times.interval(text, -1)

    t0, t1 = when(1, "startSliceAt", "now"), when(2, "endSliceAt", "now")
    return a.series(0).map(F.when(F.col("ts").between(t0, t1), V())).call(a.fn, str(t0), str(t1))


@register("delay", group="Transform", args="seriesList, steps")
def delay(ctx, a: Args) -> SeriesFrame:
    """Values moved by a number of points; the places left are absent."""
    n, frame = a.integer(1, "steps"), a.series(0)
    points = frame.points.select("sid", "ts", F.lag("v", n).over(by_series()).alias("v"))
    return frame.with_points(points).call(a.fn, str(n))
