"""Series made from nothing but the range."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..lang import times
from ..model import SERIES, SeriesFrame, TS, empty_map
from .registry import Args, EvalError, fmt, register



def _line(ctx, name: str, step: int, start: int | None = None, stop: int | None = None):
    start, stop = ctx.start if start is None else start, ctx.stop if stop is None else stop
    row = ctx.spark.range(1).select(
        F.lit(1).cast("long").alias("sid"), F.lit(1).alias("ord"), F.lit(name).alias("name"), F.lit(name).alias("path_expr"), F.create_map(F.lit("name"), F.lit(name)).alias("tags"),
        F.lit(start).cast("long").alias("start"), F.lit(stop).cast("long").alias("stop"), F.lit(step).cast("long").alias("step"), F.lit("average").alias("cons_func"), F.lit(0.0).alias("xff"), empty_map().alias("opts"),
    )
    return row.select(*SERIES)


def _points(ctx, step: int, v: Column):
    """Every step of the range: ids are numbers, so a long range is spread over tasks."""
    n = max(0, -(-(ctx.stop - ctx.start) // step))
    return ctx.spark.range(n).select(F.lit(1).cast("long").alias("sid"), (F.lit(ctx.start) + F.col("id") * step).alias("ts")).select("sid", "ts", v.cast("double").alias("v"))


@register("constantLine", group="Special", args="value")
def constant_line(ctx, a: Args) -> SeriesFrame:
    """A level line of two points."""
    c = a.number(0, "value")
    step = max(1, ctx.stop - ctx.start)
    points = ctx.spark.range(2).select(F.lit(1).cast("long").alias("sid"), (F.lit(ctx.start) + F.col("id") * step).alias("ts"), F.lit(c).alias("v"))
    return SeriesFrame(_line(ctx, fmt(c), step, stop=ctx.stop + step), points, step)


@register("identity", group="Special", args="name")
def identity(ctx, a: Args) -> SeriesFrame:
    """The time itself, each minute."""
    name = a.string(0, "name")
    return SeriesFrame(_line(ctx, f"identity({name})", 60), _points(ctx, 60, TS()), 60)


@register("time", "timeFunction", group="Special", args="name, step=60")
def time_function(ctx, a: Args) -> SeriesFrame:
    """The time itself, each step."""
    step = a.integer(1, "step", 60)
    if step < 1:
        raise EvalError(f"{a.fn}: the step must be positive")
    return SeriesFrame(_line(ctx, a.string(0, "name"), step), _points(ctx, step, TS()), step)


@register("sin", "sinFunction", group="Special", args="name, amplitude=1, step=60")
def sin_function(ctx, a: Args) -> SeriesFrame:
    """An amplitude times the sine of the time."""
    k, step = a.number(1, "amplitude", 1.0), a.integer(2, "step", 60)
    if step < 1:
        raise EvalError(f"{a.fn}: the step must be positive")
    return SeriesFrame(_line(ctx, a.string(0, "name"), step), _points(ctx, step, F.sin(TS().cast("double")) * k), step)


@register("randomWalk", "randomWalkFunction", group="Special", args="name, step=60")
def random_walk(ctx, a: Args) -> SeriesFrame:
    """A running sum of steps in -0.5..0.5 that depend only on the name and the time, so a lost task gives them again."""
    name, step = a.string(0, "name"), a.integer(1, "step", 60)
    if step < 1:
        raise EvalError(f"{a.fn}: the step must be positive")
    jump = F.pmod(F.xxhash64(F.lit(name), TS()), F.lit(2**32)).cast("double") / float(2**32) - 0.5
    w = Window.partitionBy("sid").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = _points(ctx, step, jump)
    return SeriesFrame(_line(ctx, name, step), rows.select("sid", "ts", F.sum("v").over(w).alias("v")), step)


@register("verticalLine", group="Graph", args="ts, label=None, color=None")
def vertical_line(ctx, a: Args) -> SeriesFrame:
    """A mark at one time, within the range."""
    node = a.get(0, "ts")
    at = times.at_time(str(node.value) if node.kind != "number" else str(int(node.value)), ctx.now)
    if not ctx.start <= at <= ctx.stop:
        raise EvalError("verticalLine: the time is outside the range")
    label, color = a.string(1, "label", ""), a.string(2, "color", "")
    opts = F.create_map(F.lit("drawAsInfinite"), F.lit("true"), *([F.lit("color"), F.lit(color)] if color else []))
    line = _line(ctx, label, 1, at, at + 2).withColumn("opts", opts)
    points = ctx.spark.range(2).select(F.lit(1).cast("long").alias("sid"), (F.lit(at) + F.col("id")).alias("ts"), F.lit(1.0).alias("v"))
    return SeriesFrame(line, points, 1)


@register("seriesByTag", group="Special", args="*tagExpressions")
def series_by_tag(ctx, a: Args) -> SeriesFrame:
    """Series by their tags; the parser reads a tag query as a name, so this serves calls built by other functions."""
    return ctx.read("seriesByTag(" + ",".join(f"'{n.value}'" for n in a.node.args) + ")")
