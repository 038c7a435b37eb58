"""Other periods next to this one: ranges read elsewhere and stamped anew."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..lang import times
from ..model import SeriesFrame, V, nodes_of, renumber
from . import aggs
from .registry import Args, EvalError, register
from .setops import concat


def shifted(ctx, a: Args, i: int, offset: int) -> SeriesFrame:
    """An argument as it was `offset` seconds from now, at the times of now."""
    f = a.series(i, ctx.start + offset, ctx.stop + offset)
    points = f.points.select("sid", (F.col("ts") - F.lit(offset)).alias("ts"), "v")
    return f.with_points(points).with_series(f.series.withColumns({"start": F.col("start") - offset, "stop": F.col("stop") - offset}))


@register("timeShift", group="Transform", args="seriesList, timeShift, resetEnd=False, alignDST=False")
def time_shift(ctx, a: Args) -> SeriesFrame:
    """The list as it was a while ago; a shift without a sign goes back."""
    offset = a.seconds(1, "timeShift", sign=-1)
    reset = a.boolean(2, "resetEnd", ctx.engine.reset_end)
    f = shifted(ctx, a, 0, offset)
    if reset:
        f = f.with_points(f.points.where(F.col("ts") < ctx.stop))
    return f.call(a.fn, f"'{offset}'", str(reset).lower())


def copies(ctx, a: Args, i: int, offsets: list[int]) -> SeriesFrame:
    """The argument once per offset, one list after the other, with the column `copy` of the series saying which.

    A pattern is read once, over all periods together, and each of its points goes
    to the periods it is in; a series has a copy for each period in which it has a
    value. Other expressions are evaluated period by period, as their results can
    hang on the range.
    """
    node = a.node.args[i]
    if node.kind != "name" or str(node.value) in ctx.bound:
        frames = [shifted(ctx, a, i, off) for off in offsets]
        return concat([f.with_series(f.series.withColumn("copy", F.lit(k))) for k, f in enumerate(frames)])
    f = a.series(i, ctx.start + min(offsets), ctx.stop + max(offsets))
    shifts = F.array(*(F.struct(F.lit(k).alias("copy"), F.lit(off).cast("long").alias("off")) for k, off in enumerate(offsets)))
    sid = F.xxhash64("sid", "s.copy").alias("sid")
    fits = F.filter(shifts, lambda s: (F.col("ts") >= s["off"] + ctx.start) & (F.col("ts") < s["off"] + ctx.stop))
    points = f.points.select("sid", "ts", "v", F.explode(fits).alias("s")).select(sid, (F.col("ts") - F.col("s.off")).alias("ts"), "v")
    up = lambda t: (F.ceil((F.lit(t) + F.col("s.off")) / F.col("step")) * F.col("step")).cast("long")
    rest = [c for c in f.series.columns if c not in ("sid", "start", "stop")]
    series = f.series.select("*", F.explode(shifts).alias("s")).select(
        sid, (F.greatest("start", up(ctx.start)) - F.col("s.off")).alias("start"), (F.least("stop", up(ctx.stop)) - F.col("s.off")).alias("stop"), F.col("s.copy").alias("copy"), *rest
    )
    some = points.where(V().isNotNull()).select("sid").distinct()
    made = SeriesFrame(renumber(series, F.col("copy"), F.col("ord")), points, f.step)
    return made.keep(some)


@register("timeStack", group="Transform", args="seriesList, timeShiftUnit='1d', timeShiftStart=0, timeShiftEnd=7")
def time_stack(ctx, a: Args) -> SeriesFrame:
    """One copy of the list per whole multiple of a shift."""
    text = a.string(1, "timeShiftUnit", "1d")
    unit = times.interval(text, -1)
    i0, i1 = a.integer(2, "timeShiftStart", 0), a.integer(3, "timeShiftEnd", 7)
    if i0 >= i1:
        return ctx.empty()
    f = copies(ctx, a, 0, [unit * i for i in range(i0, i1)])
    name = F.concat(F.lit("timeShift("), F.col("name"), F.lit(f",'{text}',"), (F.col("copy") + i0).cast("string"), F.lit(")"))
    return f.with_series(renumber(f.series.withColumn("name", name), F.col("ord")).drop("copy"))


@register("baseline", "baselineAberration", group="Calculate", args="seriesList, timeShiftUnit, timeShiftStart, timeShiftEnd, maxAbsentPercent=100, minAvg=0")
def baseline(ctx, a: Args) -> SeriesFrame:
    """The median of earlier periods at each time, or the current value over it."""
    unit = a.seconds(1, "timeShiftUnit", sign=-1)
    i0, i1 = a.integer(2, "timeShiftStart"), a.integer(3, "timeShiftEnd")
    absent, least = a.number(4, "maxAbsentPercent", 100.0), a.number(5, "minAvg", 0.0)
    offsets = [0, *(unit * i for i in range(i0, i1) if i != 0)]
    if len(offsets) == 1:
        raise EvalError(f"{a.fn}: no earlier period")
    every = copies(ctx, a, 0, offsets)
    now = every.with_series(every.series.where("copy = 0")).with_points(every.joined("copy").where("copy = 0").select("sid", "ts", "v"))
    # periods meet by the series' name
    mids = every.joined("name", "copy").where("copy > 0").groupBy("name", "ts").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    rows = now.joined("name").join(mids, ["name", "ts"], "left")
    out = F.col("m") if a.fn == "baseline" else F.try_divide(V(), F.col("m"))
    points = rows.select("sid", "ts", out.alias("v"))
    stats = rows.groupBy("sid").agg((F.sum(F.col("m").isNull().cast("int")) * 100.0 / F.count(F.lit(1))).alias("gone"), F.avg("m").alias("avg"))
    kept = now.with_points(points).keep(stats.where((F.col("gone") <= absent) & (F.col("avg") >= least)))
    return kept.with_series(renumber(kept.series, F.col("ord")).drop("copy")).call(a.fn)


@register("timeShiftByMetric", group="Transform", args="seriesList, markSource, versionRankIndex")
def time_shift_by_metric(ctx, a: Args) -> SeriesFrame:
    """Series of releases moved so that their marks line up with the newest one's.

    Marks are series whose last node is major_minor; a mark is where the series
    was last present. Of each major the highest minor counts, and two are needed.
    """
    f, marks, rank = a.series(0), a.series(1), a.integer(2, "versionRankIndex")
    last = F.element_at(nodes_of(F.col("name")), -1)
    at = marks.points.where(V().isNotNull()).groupBy("sid").agg(F.max("ts").alias("at"))
    named = marks.series.join(at, "sid").select(last.alias("version"), "at").where(F.col("version").rlike(r"^\d+_\d+$"))
    parts = F.split("version", "_")
    ranked = named.select("version", "at", parts[0].cast("int").alias("major"), parts[1].cast("int").alias("minor"))
    best = ranked.withColumn("k", F.row_number().over(Window.partitionBy("major").orderBy(F.desc("minor")))).where("k = 1")
    everyone = Window.partitionBy(F.lit(0))
    top = F.max_by("at", "major").over(everyone)
    offsets = best.select("version", (top - F.col("at")).alias("offset"), F.count(F.lit(1)).over(everyone).alias("n")).where("n >= 2")
    mine = f.series.withColumn("v0", F.try_element_at(nodes_of(F.col("name")), F.lit(rank + 1)))
    # a version is a mark or its beginning; marks are few, one per major
    met = mine.select("sid", "v0").join(F.broadcast(offsets), F.expr("v0 = version or startswith(version, concat(v0, '_'))"))
    one = met.groupBy("sid").agg(F.max("offset").alias("offset"))
    rows = f.points.join(one, "sid").select("sid", (F.col("ts") + F.col("offset")).alias("ts"), "v")
    series = f.series.join(one, "sid").withColumns({"start": F.col("start") + F.col("offset"), "stop": F.col("stop") + F.col("offset")}).drop("offset")
    return SeriesFrame(series, rows, f.step).call(a.fn)


__all__ = ["aggs", "shifted"]
