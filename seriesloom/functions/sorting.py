"""Order of the list, and the first of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import SeriesFrame, TS, V, natural_key, renumber
from . import aggs
from .moving import pair_points
from .registry import Args, EvalError, register



def _keyed(f: SeriesFrame, key: Column) -> SeriesFrame:
    sums = f.points.groupBy("sid").agg(key.alias("k"))
    return f.with_series(f.series.join(sums, "sid", "left"))


def _ordered(f: SeriesFrame, down: bool) -> SeriesFrame:
    k = F.coalesce(F.nanvl("k", F.lit(None)), F.lit(float("-inf")))
    return f.with_series(renumber(f.series, k.desc() if down else k.asc(), F.col("ord")).drop("k"))


def _sort(ctx, a: Args, func: str, down: bool) -> SeriesFrame:
    return _ordered(_keyed(a.series(0), aggs.summarise(func, V(), TS())), down)


@register("sortBy", group="Sorting", args="seriesList, func='average', reverse=False")
def sort_by(ctx, a: Args) -> SeriesFrame:
    """By an aggregate of the values, ascending unless reversed."""
    return _sort(ctx, a, aggs.known_summary(a.string(1, "func", "average")), a.boolean(2, "reverse", False))


@register("sortByMaxima", group="Sorting")
def sort_by_maxima(ctx, a: Args) -> SeriesFrame:
    """By the largest value, descending."""
    return _sort(ctx, a, "max", True)


@register("sortByMinima", group="Sorting")
def sort_by_minima(ctx, a: Args) -> SeriesFrame:
    """By the smallest value, ascending."""
    return _sort(ctx, a, "min", False)


@register("sortByTotal", group="Sorting")
def sort_by_total(ctx, a: Args) -> SeriesFrame:
    """By the sum of the values, descending."""
    return _sort(ctx, a, "sum", True)


@register("sortByName", group="Sorting", args="seriesList, natural=False, reverse=False")
def sort_by_name(ctx, a: Args) -> SeriesFrame:
    """By name, digits as numbers if natural."""
    f, natural, down = a.series(0), a.boolean(1, "natural", False), a.boolean(2, "reverse", False)
    k = natural_key(F.col("name")) if natural else F.col("name")
    return f.with_series(renumber(f.series, k.desc() if down else k.asc(), F.col("ord")))


def _first(f: SeriesFrame, n: int) -> SeriesFrame:
    return f.keep(f.series.where(F.col("ord") <= max(n, 0)))


@register("limit", group="Filter Series", args="seriesList, n")
def limit(ctx, a: Args) -> SeriesFrame:
    """The first n series of the list."""
    f, n = a.series(0), a.integer(1, "n")
    return _first(f.with_series(renumber(f.series, F.col("ord"))), n)


def _extreme(ctx, a: Args, func: str, n: int, highest: bool) -> SeriesFrame:
    """The n series with the largest or smallest aggregate; a list that is no longer than n stays in its order."""
    f = a.series(0)
    keyed = _keyed(f, aggs.summarise(func, V(), TS()))
    k = F.nanvl("k", F.lit(None))
    some = keyed.series.where(k.isNotNull())
    size = F.count(F.lit(1)).over(_all())
    ranked = some.withColumn("__n", size).withColumn("__r", F.row_number().over(_all().orderBy(k.desc() if highest else k.asc(), F.col("ord"))))
    best = ranked.where(F.col("__r") <= n).withColumn("ord", F.when(F.col("__n") <= n, F.col("ord")).otherwise(F.col("__r")))
    out = f.keep(best)
    return out.with_series(renumber(best.drop("k", "__n", "__r"), F.col("ord")))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def _register_extreme(word: str, what: str, func: str | None, highest: bool) -> None:
    def build(ctx, a: Args) -> SeriesFrame:
        if func:
            return _extreme(ctx, a, func, a.integer(1, "n", 1), highest)
        if a.is_string(1):  # (list, func)
            return _extreme(ctx, a, aggs.known_summary(a.string(1)), 1, highest)
        return _extreme(ctx, a, aggs.known_summary(a.string(2, "func", "average")), a.integer(1, "n", 1), highest)

    build.__doc__ = f"The n series with the {word} {func or 'aggregate'}."
    register(word + what, group="Filter Series", args="seriesList, n" if func else "seriesList, n=1, func='average'")(build)


for _word, _high in (("highest", True), ("lowest", False)):
    for _what, _func in (("", None), ("Average", "average"), ("Current", "current"), ("Max", "max"), ("Min", "min")):
        _register_extreme(_word, _what, _func, _high)


@register("mostDeviant", group="Filter Series", args="seriesList, n")
def most_deviant(ctx, a: Args) -> SeriesFrame:
    """The n series with the largest variance."""
    at = 0 if a.node.args[0].kind == "number" else 1
    n, f = a.integer(at), a.series(1 - at)
    k = F.var_pop("v")
    keyed = _ordered(_keyed(f, k), True)
    return _first(keyed, n)


@register("pearsonClosest", group="Filter Series", args="seriesList, seriesList, n, direction='abs'")
def pearson_closest(ctx, a: Args) -> SeriesFrame:
    """The n series of the second list that correlate best with the one series of the first."""
    n, how = a.integer(2, "n"), a.string(3, "direction", "abs")
    if how not in ("abs", "pos", "neg"):
        raise EvalError(f"pearsonClosest: unknown direction {how}")
    ref, f = a.series(0), a.series(1)
    if ref.series.limit(2).count() != 1:
        raise EvalError("pearsonClosest: the first argument must be one series")
    both = pair_points(f, ref).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    flat = (F.stddev_pop("a") == 0) | (F.stddev_pop("b") == 0)
    r = F.when(~flat, F.corr("a", "b"))
    key = {"abs": F.abs(r), "pos": r, "neg": -r}[how]
    best = both.groupBy("sid").agg(key.alias("k")).where(F.col("k").isNotNull() & ~F.isnan("k"))
    out = f.with_series(f.series.join(best, "sid"))
    ranked = _ordered(out, True)
    return _first(f.keep(ranked.series).with_series(ranked.series), n)
