"""Tumbling buckets in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lang import times
from ..model import SeriesFrame, V
from .aggs import known_summary, summarise
from .registry import Args, EvalError, register

#: Buckets of whole weeks begin on a Monday; 1970-01-05 was one.
_WEEK, _MONDAY = 604800, 4 * 86400


def _floor(ts, b: int):
    """A time taken down to a multiple of b; of weeks, to the Monday."""
    shift = _MONDAY if b % _WEEK == 0 else 0
    return ts - F.pmod(ts - F.lit(shift), F.lit(b))


def _bucketed(f: SeriesFrame, slot, b: int, func: str, start, stop) -> SeriesFrame:
    """One value per bucket; buckets of [start, stop) without points are absent ones."""
    meta = f.series.select("sid", F.col("xff"), start.cast("long").alias("s0"), stop.cast("long").alias("s1"))
    rows = f.points.join(f.series.select("sid", "start", "xff"), "sid").select("sid", slot.cast("long").alias("slot"), F.col("ts").alias("at"), "v", "xff")
    sums = rows.groupBy("sid", "slot").agg(summarise(func, V(), F.col("at"), F.col("xff")).alias("v"))
    grid = meta.where("s1 > s0").select("sid", F.explode(F.sequence("s0", F.col("s1") - b, F.lit(b).cast("long"))).alias("slot"))
    points = grid.join(sums, ["sid", "slot"], "left").select("sid", F.col("slot").alias("ts"), F.nanvl("v", F.lit(None)).alias("v"))
    series = f.series.withColumns({"start": start.cast("long"), "stop": stop.cast("long"), "step": F.lit(b).cast("long")})
    return SeriesFrame(series, points, b)


@register("summarize", group="Transform", args="seriesList, intervalString, func='sum', alignToFrom=False")
def summarize(ctx, a: Args) -> SeriesFrame:
    """Tumbling buckets of an interval, on multiples of it or from the series' start; one bucket follows the last."""
    f, b = a.series(0), a.seconds(1, "intervalString")
    func, from_start = known_summary(a.string(2, "func", "sum")), a.boolean(3, "alignToFrom", False)
    if b <= 0:
        raise EvalError("summarize: the interval must be positive")
    shown = [f"'{a.string(1, 'intervalString')}'"] + ([f"'{func}'"] if a.get(2, "func") else []) + (["true"] if from_start else [])
    if from_start:
        slot = F.col("start") + F.floor((F.col("ts") - F.col("start")) / F.lit(b)) * F.lit(b)
        stop = F.col("start") + F.ceil((F.col("stop") - F.col("start")) / F.lit(b)) * F.lit(b)
        return _bucketed(f, slot, b, func, F.col("start"), stop).call(a.fn, *shown)
    start, cut = _floor(F.col("start"), b), _floor(F.col("stop"), b)
    stop = F.when(cut == F.col("stop"), cut).otherwise(cut + b) + b
    return _bucketed(f, _floor(F.col("ts"), b), b, func, start, stop).call(a.fn, *shown)


@register("smartSummarize", group="Transform", args="seriesList, intervalString, func='sum', alignTo=None")
def smart_summarize(ctx, a: Args) -> SeriesFrame:
    """Tumbling buckets from the start of the range, which may first be taken back to a unit of time."""
    b, func = a.seconds(1, "intervalString"), known_summary(a.string(2, "func", "sum"))
    unit = a.get(3, "alignTo")
    start = ctx.start
    if unit is not None and unit.kind == "string":
        start = times.align_start(ctx.start, str(unit.value))
    f = a.series(0, start, ctx.stop)
    slot = F.col("start") + F.floor((F.col("ts") - F.col("start")) / F.lit(b)) * F.lit(b)
    stop = F.col("start") + F.ceil((F.col("stop") - F.col("start")) / F.lit(b)) * F.lit(b)
    return _bucketed(f, slot, b, func, F.col("start"), stop).call(a.fn, f"'{a.string(1, 'intervalString')}'", f"'{func}'")


def _floor_unit(ts: int, b: int) -> int:
    unit = 86400 if b >= 86400 else 3600 if b >= 3600 else 60 if b >= 60 else 1
    return ts - ts % unit


@register("hitcount", group="Transform", args="seriesList, intervalString, alignToInterval=False")
def hitcount(ctx, a: Args) -> SeriesFrame:
    """Values times seconds, added up per bucket; a point that spans two buckets counts in both. Buckets end with the range."""
    b, aligned = a.seconds(1, "intervalString"), a.boolean(2, "alignToInterval", False)
    f = a.series(0, _floor_unit(ctx.start, b), ctx.stop) if aligned else a.series(0)
    n = F.ceil((F.col("stop") - F.col("start")) / F.lit(b))
    if aligned:
        unit = 86400 if b >= 86400 else 3600 if b >= 3600 else 60 if b >= 60 else 1
        origin = F.col("start") - F.pmod(F.col("start"), F.lit(unit))
        end = origin + F.floor((F.col("stop") - origin) / F.lit(b)) * F.lit(b) + F.lit(b)
    else:
        origin, end = F.col("stop") - n * F.lit(b), F.col("stop")
    meta = f.series.select("sid", "step", origin.cast("long").alias("o"), end.cast("long").alias("e"))
    rows = f.points.where(V().isNotNull()).join(meta, "sid")
    k0 = F.greatest(F.floor((F.col("ts") - F.col("o")) / F.lit(b)), F.lit(0))
    k1 = F.floor((F.least(F.col("ts") + F.col("step"), F.col("e")) - 1 - F.col("o")) / F.lit(b))
    cut = rows.where(k1 >= k0).select("sid", "ts", "v", "step", "o", F.explode(F.sequence(k0, k1)).alias("k"))
    s0 = F.col("o") + F.col("k") * F.lit(b)
    seconds = F.least(F.col("ts") + F.col("step"), s0 + F.lit(b)) - F.greatest(F.col("ts"), s0)
    sums = cut.groupBy("sid", s0.cast("long").alias("ts")).agg(F.sum(V() * seconds).alias("v"))
    grid = meta.where("e > o").select("sid", F.explode(F.sequence("o", F.col("e") - b, F.lit(b).cast("long"))).alias("ts"))
    series = f.series.withColumns({"start": origin.cast("long"), "stop": end.cast("long"), "step": F.lit(b).cast("long")})
    shown = [f"'{a.string(1, 'intervalString')}'"] + (["true"] if aligned else [])
    return SeriesFrame(series, grid.join(sums, ["sid", "ts"], "left").select("sid", "ts", "v"), b).call(a.fn, *shown)


_TESTS = {
    "above": lambda v, x: v > x,
    "aboveOrEqual": lambda v, x: v >= x,
    "below": lambda v, x: v < x,
    "belowOrEqual": lambda v, x: v <= x,
}


@register("slo", "sloErrorBudget", group="Transform", args="seriesList, interval, method, value, objective")
def slo(ctx, a: Args) -> SeriesFrame:
    """The share of present values of each bucket that pass a test, 0 where none is present; or the seconds above an objective."""
    b, method, x = a.seconds(1, "interval"), a.string(2, "method"), a.number(3, "value")
    if method not in _TESTS:
        raise EvalError(f"{a.fn}: unknown method {method}")
    goal = a.number(4, "objective") if a.fn == "sloErrorBudget" else None
    # a bucket longer than the range is filled from earlier on
    f = a.series(0, min(ctx.start, ctx.stop - b), ctx.stop)
    shown = ["'" + a.string(1, "interval") + "'", f"'{method}'", a.get(3, "value").text] + ([a.get(4, "objective").text] if goal is not None else [])
    stop = F.col("start") + F.ceil((F.col("stop") - F.col("start")) / F.lit(b)) * F.lit(b)
    slot = F.col("start") + F.floor((F.col("ts") - F.col("start")) / F.lit(b)) * F.lit(b)
    meta = f.series.select("sid", "start", "stop", "step")
    rows = f.points.join(meta, "sid").select("sid", slot.cast("long").alias("slot"), "v", "step", "stop")
    share = F.coalesce(F.avg(_TESTS[method](V(), F.lit(x)).cast("double")), F.lit(0.0))
    out = share if goal is None else (share - F.lit(goal)) * F.least(F.lit(b), F.max("stop") - F.col("slot"))
    points = rows.groupBy("sid", "slot").agg(F.when(F.max("step") <= b, out).alias("v")).select("sid", F.col("slot").alias("ts"), "v")
    series = f.series.withColumns({"stop": stop.cast("long"), "step": F.lit(b).cast("long")})
    return SeriesFrame(series, points, b).call(a.fn, *shown)


@register("consolidateBy", group="Special", args="seriesList, consolidationFunc")
def consolidate_by(ctx, a: Args) -> SeriesFrame:
    """How points are merged for display."""
    how = a.string(1, "consolidationFunc")
    if how not in ("average", "avg", "max", "min", "sum", "first", "last"):
        raise EvalError(f"consolidateBy: unknown function {how}")
    f = a.series(0)
    return f.with_series(f.series.withColumn("cons_func", F.lit(how))).call(a.fn, f'"{how}"').tag("consolidateBy", how)


@register("setXFilesFactor", "xFilesFactor", group="Transform", args="seriesList, xFilesFactor")
def set_xff(ctx, a: Args) -> SeriesFrame:
    """The least share of present values that merged points need."""
    x, f = a.number(1, "xFilesFactor"), a.series(0)
    return f.with_series(f.series.withColumn("xff", F.lit(x))).tag("xFilesFactor", f"{x:g}")
