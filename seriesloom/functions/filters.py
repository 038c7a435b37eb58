"""Which series, or which of their points, stay."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..lang import times
from ..model import SeriesFrame, TS, V
from . import aggs
from .combine import at_ranks
from .registry import Args, EvalError, fmt, register

INF = float("inf")
_OPS = {
    "=": lambda x, y: x == y,
    "!=": lambda x, y: x != y,
    ">": lambda x, y: x > y,
    ">=": lambda x, y: x >= y,
    "<": lambda x, y: x < y,
    "<=": lambda x, y: x <= y,
}


def having(f: SeriesFrame, value: Column, test) -> SeriesFrame:
    """The series whose aggregate passes a test: one aggregate by sid, then a semi join."""
    sums = f.points.groupBy("sid").agg(value.alias("k"))
    return f.keep(sums.where(test(F.col("k"))))


def java_regex(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


@register("filterSeries", group="Filter Series", args="seriesList, func, operator, threshold")
def filter_series(ctx, a: Args) -> SeriesFrame:
    """Series whose aggregate compares to a threshold as asked."""
    func, op, x = a.string(1, "func"), a.string(2, "operator"), a.number(3, "threshold")
    if op not in _OPS:
        raise EvalError(f"filterSeries: unknown operator {op}")
    return having(a.series(0), aggs.fold(func, V(), TS()), lambda k: _OPS[op](k, F.lit(x)))


def _register_compare(name: str, value, keep) -> None:
    def build(ctx, a: Args) -> SeriesFrame:
        x = a.number(1, "n")
        return having(a.series(0), value(), lambda k: keep(k, F.lit(x)))

    build.__doc__ = f"Series by comparing their {name.removesuffix('Above').removesuffix('Below')}: above is greater, below is not greater."
    register(name, group="Filter Series", args="seriesList, n")(build)


for _what, _value in (
    ("average", lambda: F.avg("v")),
    ("current", lambda: aggs.last_present(V(), TS())),
    # of series without a value the extremes are infinite
    ("maximum", lambda: F.coalesce(F.max("v"), F.lit(-INF))),
    ("minimum", lambda: F.coalesce(F.min("v"), F.lit(INF))),
):
    _register_compare(_what + "Above", _value, lambda k, x: k > x)
    _register_compare(_what + "Below", _value, lambda k, x: k <= x)


@register("removeEmptySeries", "removeZeroSeries", group="Filter Series", args="seriesList, xFilesFactor=None")
def remove_empty(ctx, a: Args) -> SeriesFrame:
    """Series with a present (and non-zero) value, and with enough of them."""
    xff = a.number(1, "xFilesFactor", 0.0)
    kept = V() if a.fn == "removeEmptySeries" else F.when(V() != 0, V())
    ok = (F.count(kept) > 0) & (F.count(kept) / F.count(F.lit(1)) >= xff)
    return having(a.series(0), ok, lambda k: k)


@register("removeBelowValue", "removeAboveValue", group="Filter Data", args="seriesList, n")
def remove_value(ctx, a: Args) -> SeriesFrame:
    """Points beyond a value become absent."""
    x = a.number(1, "n")
    out = F.when(V() >= x, V()) if a.fn == "removeBelowValue" else F.when(V() <= x, V())
    return a.series(0).map(out).call(a.fn, fmt(x))


@register("removeBelowPercentile", "removeAbovePercentile", group="Filter Data", args="seriesList, n")
def remove_percentile(ctx, a: Args) -> SeriesFrame:
    """Points beyond the series' own percentile become absent."""
    p, f = a.number(1, "n"), a.series(0)
    limits = f.points.groupBy("sid").agg(aggs.percentile(V(), p).alias("t"))
    t = F.col("t")
    out = F.when(V() >= t, V()) if a.fn == "removeBelowPercentile" else F.when(V() <= t, V())
    return f.with_points(f.points.join(limits, "sid").select("sid", "ts", out.alias("v"))).call(a.fn, fmt(p))


@register("removeBetweenPercentile", group="Filter Series", args="seriesList, n")
def remove_between_percentile(ctx, a: Args) -> SeriesFrame:
    """Series that are outside the band of the n-th and (100-n)-th percentile of all series at some time."""
    n, f = a.number(1, "n"), a.series(0)
    n = max(n, 100 - n)
    bands = at_ranks(f.points, ["ts"], 100 - n, n).select("ts", F.col("r0").alias("lo"), F.col("r1").alias("hi"))
    out = f.points.join(bands, "ts").where((V() < F.col("lo")) | (V() > F.col("hi"))).select("sid").distinct()
    return f.keep(out)


@register("averageOutsidePercentile", group="Filter Series", args="seriesList, n")
def average_outside_percentile(ctx, a: Args) -> SeriesFrame:
    """Series whose average is not inside the band of the percentiles of all averages."""
    n, f = a.number(1, "n"), a.series(0)
    n = max(n, 100 - n)
    means = f.points.groupBy("sid").agg(F.avg("v").alias("m"))
    band = aggs.order_values(means.select(F.col("m").alias("v")), aggs.ceil_place(100 - n), aggs.ceil_place(n)).select(F.col("r0").alias("lo"), F.col("r1").alias("hi"), F.lit(1).alias("__k"))
    met = means.withColumn("__k", F.lit(1)).join(F.broadcast(band), "__k")  # one row
    return f.keep(met.where(~((F.col("m") > F.col("lo")) & (F.col("m") < F.col("hi")))))


@register("tukeyAbove", "tukeyBelow", group="Filter Series", args="seriesList, basis, n, interval=0")
def tukey(ctx, a: Args) -> SeriesFrame:
    """The n series with the most points beyond Tukey's fence over all points."""
    basis, n = a.number(1, "basis"), a.integer(2, "n")
    if basis <= 0 or n < 1:
        raise EvalError(f"{a.fn}: basis and n are positive")
    f = a.series(0)
    points = f.points.where(V().isNotNull())
    if a.get(3, "interval") is not None:
        arg = a.get(3, "interval")
        span = abs(times.interval(str(arg.value))) if arg.kind == "string" else int(arg.value) * f.common_step()
        if span:
            points = points.where(TS() >= ctx.stop - span)
    fence = aggs.order_values(points, lambda k: F.floor(k * 0.25), lambda k: F.floor(k * 0.75)).select(F.col("r0").alias("q1"), F.col("r1").alias("q3"))
    limit = F.col("q3") + basis * (F.col("q3") - F.col("q1")) if a.fn == "tukeyAbove" else F.col("q1") - basis * (F.col("q3") - F.col("q1"))
    fence = fence.select(F.lit(1).alias("__k"), limit.alias("fence"))
    met = points.withColumn("__k", F.lit(1)).join(F.broadcast(fence), "__k")  # one row
    beyond = V() > F.col("fence") if a.fn == "tukeyAbove" else V() < F.col("fence")
    hits = met.where(beyond).groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    best = hits.join(f.series.select("sid", "ord"), "sid").orderBy(F.desc("c"), "ord").limit(n)
    return f.keep(best)


@register("grep", group="Filter Series", args="seriesList, pattern")
def grep(ctx, a: Args) -> SeriesFrame:
    """Series whose name matches a regular expression."""
    f = a.series(0)
    return f.keep(f.series.where(F.col("name").rlike(java_regex(a.string(1, "pattern")))))


@register("exclude", group="Filter Series", args="seriesList, pattern")
def exclude(ctx, a: Args) -> SeriesFrame:
    """Series whose name does not match a regular expression."""
    f = a.series(0)
    return f.keep(f.series.where(~F.col("name").rlike(java_regex(a.string(1, "pattern")))))


@register("unique", group="Filter Series", args="*seriesLists")
def unique(ctx, a: Args) -> SeriesFrame:
    """The first series of each name."""
    f = a.all_series()
    first = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    return f.keep(f.series.withColumn("k", first).where("k = 1"))
