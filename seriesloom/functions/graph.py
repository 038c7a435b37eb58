"""How a series is to be drawn: options kept beside the series; drawing itself is not done here."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SeriesFrame, V
from .registry import Args, EvalError, fmt, register



def with_opts(f: SeriesFrame, **opts: str) -> SeriesFrame:
    pairs = [F.lit(x) for kv in opts.items() for x in kv]
    kept = F.map_filter("opts", lambda k, _: ~k.isin(*opts))
    return f.with_series(f.series.withColumn("opts", F.map_concat(kept, F.create_map(*pairs))))


@register("color", group="Graph", args="seriesList, theColor")
def color(ctx, a: Args) -> SeriesFrame:
    """The colour of the line."""
    return with_opts(a.series(0), color=a.string(1, "theColor"))


@register("alpha", group="Graph", args="seriesList, alpha")
def alpha(ctx, a: Args) -> SeriesFrame:
    """The opacity of the line."""
    return with_opts(a.series(0), alpha=fmt(a.number(1, "alpha")))


@register("dashed", group="Graph", args="seriesList, dashLength=5")
def dashed(ctx, a: Args) -> SeriesFrame:
    """A dashed line."""
    n = a.number(1, "dashLength", 2.5)
    return with_opts(a.series(0), dashed=fmt(n)).call(a.fn, fmt(n))


@register("drawAsInfinite", group="Graph")
def draw_as_infinite(ctx, a: Args) -> SeriesFrame:
    """Present values as lines from bottom to top."""
    return with_opts(a.series(0), drawAsInfinite="true").call(a.fn)


@register("secondYAxis", group="Graph")
def second_y_axis(ctx, a: Args) -> SeriesFrame:
    """Drawn against the second axis."""
    return with_opts(a.series(0), secondYAxis="true").call(a.fn)


@register("lineWidth", group="Graph", args="seriesList, width")
def line_width(ctx, a: Args) -> SeriesFrame:
    """The width of the line."""
    return with_opts(a.series(0), lineWidth=fmt(a.number(1, "width")))


@register("stacked", group="Graph", args="seriesLists, stackName='__DEFAULT__'")
def stacked(ctx, a: Args) -> SeriesFrame:
    """Drawn on top of the series of one stack before it."""
    name = a.string(1, "stackName", "__DEFAULT__")
    out = with_opts(a.series(0), stacked="true", stackName=name)
    return out.call(a.fn) if name == "__DEFAULT__" else out


@register("areaBetween", group="Graph")
def area_between(ctx, a: Args) -> SeriesFrame:
    """Two series as the area between them: the second becomes its distance from the first."""
    f = a.series(0)
    if f.series.limit(3).count() != 2:
        raise EvalError("areaBetween needs two series")
    low = f.joined("ord").where("ord = 1").select("ts", F.col("v").alias("lo"))
    rows = f.joined("ord").join(low, "ts", "left")
    out = F.when(F.col("ord") == 2, V() - F.col("lo")).otherwise(V())
    shown = F.concat(F.lit("areaBetween("), F.lit(a.node.args[0].text), F.lit(")"))
    return with_opts(f.with_points(rows.select("sid", "ts", out.alias("v"))).rename(shown), stacked="true", stackName="areaBetween")


@register("threshold", group="Graph", args="value, label=None, color=None")
def threshold(ctx, a: Args) -> SeriesFrame:
    """A level line with a label and a colour."""
    from .generate import constant_line

    f = constant_line(ctx, a)
    label, shade = a.string(1, "label", ""), a.string(2, "color", "")
    out = f.rename(F.lit(label)) if label else f
    return with_opts(out, color=shade) if shade else out
