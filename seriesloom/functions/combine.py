"""Across series: hash aggregates on the timestamp, with keys from names and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.parser import Node, call
from ..model import NULL, SeriesFrame, V, empty_map, inner_metric, node_key, nodes_of, renumber
from . import aggs, align
from .registry import REGISTRY, Args, EvalError, few, register
from .setops import concat

BARE = ("sum", "total", "avg", "average", "avg_zero", "max", "min", "last", "current", "first", "range", "rangeOf", "median", "multiply", "diff", "count", "stddev")


def rest_of(xs: Column) -> Column:
    """All but the first element."""
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))


def with_common_tags(dims: DataFrame, keyed: DataFrame) -> DataFrame:
    """`dims`, one row per `key`, with `tags`: those that all series of the key have in common.

    Tags are counted, and those stay that are counted as often as there are
    series, so no row ever holds the tags of a group.
    """
    each = keyed.select("key", F.explode(F.map_entries(F.coalesce("tags", empty_map()))).alias("e"))
    counts = each.groupBy("key", "e").agg(F.count(F.lit(1)).alias("c"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    shared = counts.join(sizes, ["key", "c"]).groupBy("key").agg(F.map_from_entries(F.collect_list("e")).alias("tags"))
    return dims.join(shared, "key", "left").withColumn("tags", F.coalesce("tags", empty_map()))


def at_ranks(rows: DataFrame, keys: list[str], *percents: float) -> DataFrame:
    """`keys, r0, r1, ...`: of the present values `v` of each key, in order, those at places ceil((n-1)p/100).

    Values are counted first, and counts are run through in order, so a key is
    sorted on disk if need be, and never one row. Absent for other percents.
    """
    counts = rows.groupBy(*keys, "v").agg(F.count("v").alias("c"))
    w = Window.partitionBy(*keys)
    run = counts.select(*keys, "v", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("to"), F.sum("c").over(w).alias("n"))
    return run.groupBy(*keys).agg(*(_at_rank(p).alias(f"r{i}") for i, p in enumerate(percents)))


def _at_rank(p: float) -> Column:
    if not 0 <= p <= 100:
        return F.max(NULL())
    return F.min(F.when(F.col("to") > F.ceil((F.col("n") - 1) * F.lit(p) / F.lit(100.0)), V()))


def grouped(f: SeriesFrame, key: Column, how, name: Column, xff: float | None = None, tags: Column | None = None) -> SeriesFrame:
    """One series per key of the series table, in order of first appearance.

    `how` makes an aggregate from (value, order). Partial aggregation runs before
    the exchange on (key, ts), so a key with most of the series is reduced where
    its points are.
    """
    f = align.common(f)
    keyed = f.series.withColumn("key", key)
    sid = F.xxhash64("key").alias("gid")
    dims = keyed.groupBy("key").agg(
        F.min("ord").alias("ord"), F.min_by("name", "ord").alias("first_name"), F.min("start").alias("start"),
        F.max("stop").alias("stop"), F.max("step").alias("step"), F.min_by("cons_func", "ord").alias("cons_func"), F.min_by("xff", "ord").alias("xff"),
    )
    if tags is None:
        dims = with_common_tags(dims, keyed)
    made = dims.select(
        sid.alias("sid"), "ord", name.alias("name"), F.col("first_name").alias("path_expr"), (tags if tags is not None else F.col("tags")).alias("tags"), "start", "stop", "step", "cons_func", "xff", empty_map().alias("opts")
    )
    value = how(V(), F.col("ord"))
    if xff is not None and xff > 0:
        value = F.when(F.count("v") / F.count(F.lit(1)) >= xff, value)
    rows = f.points.join(keyed.select("sid", sid, "ord"), "sid")
    points = rows.groupBy("gid", "ts").agg(value.alias("v")).select(F.col("gid").alias("sid"), "ts", F.nanvl("v", NULL()).alias("v"))
    return SeriesFrame(renumber(made, F.col("ord")), points, f.step)


def _fold(name: str):
    return lambda v, order: aggs.fold(name, v, order)


def _arg_text(a: Args) -> str:
    return ",".join(n.text for n in a.node.args)


@register("aggregate", group="Combine", args="seriesList, func, xFilesFactor=None")
def aggregate(ctx, a: Args) -> SeriesFrame:
    """All series as one by an aggregate, where enough of them are present."""
    func = a.string(1, "func").removesuffix("Series")
    f = a.series(0)
    return grouped(f, F.lit(0), _fold(func), F.lit(f"{func}Series({a.node.args[0].text})"), a.number(2, "xFilesFactor", None)).tag("aggregatedBy", func)


def _register_bare(func: str) -> None:
    def build(ctx, a: Args) -> SeriesFrame:
        if a.is_string(1):  # the form of aggregate()
            return aggregate(ctx, a)
        f = a.all_series()
        return grouped(f, F.lit(0), _fold(func), F.lit(f"{func}Series({_arg_text(a)})")).tag("aggregatedBy", func)

    build.__doc__ = f"All series as one: the {func} of the values at each time."
    register(func, func + "Series", group="Combine", args="*seriesLists")(build)


for _n in BARE:
    _register_bare(_n)


@register("aggregateWithWildcards", group="Combine", args="seriesList, func, *positions")
def aggregate_with_wildcards(ctx, a: Args) -> SeriesFrame:
    """Groups of series whose paths agree but for the listed nodes."""
    return _wildcards(a.series(0), a.string(1, "func"), [int(n) for n in a.nodes(2)])


def _wildcards(f: SeriesFrame, func: str, positions: list[int]) -> SeriesFrame:
    kept = F.filter(nodes_of(F.col("name")), lambda x, i: ~i.isin(positions) if positions else F.lit(True))
    return grouped(f, F.array_join(kept, "."), _fold(func), F.col("key")).tag("aggregatedBy", func)


def _register_wildcards(name: str, func: str) -> None:
    def build(ctx, a: Args) -> SeriesFrame:
        return _wildcards(a.series(0), func, [int(n) for n in a.nodes(1)])

    build.__doc__ = f"The {func} of series whose paths agree but for the listed nodes."
    register(name, group="Combine", args="seriesList, *position")(build)


for _n, _f in (("sumSeriesWithWildcards", "sum"), ("averageSeriesWithWildcards", "average"), ("multiplySeriesWithWildcards", "multiply")):
    _register_wildcards(_n, _f)


def _callback(ctx, f: SeriesFrame, key: Column, func: str, name: Column) -> SeriesFrame:
    """Groups folded by an aggregate or, for any other function, that function applied to each group."""
    bare = func.removesuffix("Series")
    if bare in aggs.FOLDS:
        return grouped(f, key, _fold(bare), name).tag("aggregatedBy", bare)
    if func not in REGISTRY:
        raise EvalError(f"unknown function {func}")
    # each group becomes an expression of its own, so there may be so many at most
    keyed = f.series.withColumn("key", key)
    frames = []
    for row in few(keyed.groupBy("key").agg(F.min("ord").alias("ord")).orderBy("ord"), f"groups for {func}"):
        part = f.keep(keyed.where(F.col("key") == row["key"]))
        node = call(func, (Node("name", row["key"], row["key"]),))
        out = ctx.bind(**{row["key"]: part}).eval(node)
        first = out.series.where(F.col("ord") == 1) if func != "group" else out.series
        frames.append(out.keep(first).rename(F.lit(row["key"])))
    return concat(frames) if frames else ctx.empty()


@register("groupByNode", "groupByNodes", group="Combine", args="seriesList, nodeNum, callback='average'")
def group_by_node(ctx, a: Args) -> SeriesFrame:
    """Groups of series by path nodes or tags, each folded by a function."""
    if a.fn == "groupByNode":
        key, func = node_key([a.nodes(1)[0]]), a.string(2, "callback", "average")
    else:
        key, func = node_key(a.nodes(2)), a.string(1, "callback")
    return _callback(ctx, a.series(0), key, func, F.col("key"))


@register("groupByTags", group="Combine", args="seriesList, callback, *tags")
def group_by_tags(ctx, a: Args) -> SeriesFrame:
    """Groups of series by tags; names are the path (or the callback) with the tags in order."""
    func, tags = a.string(1, "callback"), [str(t) for t in a.nodes(2)]
    head = F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")) if "name" in tags else F.lit(func)
    parts = [F.concat(F.lit(f";{t}="), F.coalesce(F.try_element_at("tags", F.lit(t)), F.lit(""))) for t in sorted(t for t in tags if t != "name")]
    return _callback(ctx, a.series(0), F.concat(head, *parts), func, F.col("key"))


@register("percentileOfSeries", group="Combine", args="seriesList, n, interpolate=False")
def percentile_of_series(ctx, a: Args) -> SeriesFrame:
    """The percentile of the values at each time."""
    p, between = a.number(1, "n"), a.boolean(2, "interpolate", False)
    f = align.common(a.series(0))
    out = grouped(f, F.lit(0), lambda v, _: aggs.percentile(v, p) if between else F.max(v), F.lit(f"percentileOfSeries({a.node.args[0].text},{a.get(1, 'n').text})"))
    if between:
        return out
    # the one series of the result is the group of key 0
    return out.with_points(at_ranks(f.points, ["ts"], p).select(F.xxhash64(F.lit(0)).alias("sid"), "ts", F.col("r0").alias("v")))


@register("powSeries", group="Combine", args="*seriesLists")
def pow_series(ctx, a: Args) -> SeriesFrame:
    """The first value to the power of the second, and so on; absent where any is, or where the result is infinite."""

    def how(v: Column, order: Column) -> Column:
        listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), v.alias("v")))), lambda x: x["v"])
        out = F.aggregate(rest_of(listed), listed[0], lambda acc, x: F.pow(acc, x))
        return F.when((F.count(v) == F.count(F.lit(1))) & (F.abs(out) != float("inf")), out)

    return grouped(a.all_series(), F.lit(0), how, F.lit(f"powSeries({_arg_text(a)})"))


@register("countValues", group="Combine", args="*seriesLists, valuesLimit=32")
def count_values(ctx, a: Args) -> SeriesFrame:
    """One series per distinct whole value: how many series have it at each time; beyond the limit one series of zeros."""
    limit = int(a.number(99, "valuesLimit", 32))
    f = align.common(a.all_series())
    ints = f.points.where(V().isNotNull()).select("ts", V().cast("long").alias("k"))
    counts = ints.groupBy("k", "ts").agg(F.count(F.lit(1)).cast("double").alias("v"))
    # the limit bounds what is looked at: limit + 1 values at most
    few = ints.select("k").distinct().limit(limit + 1)
    span = f.series.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("step").alias("step"))
    if few.count() > limit:
        series = span.select(F.lit(1).cast("long").alias("sid"), F.lit(1).alias("ord"), F.lit("valuesLimitReached").alias("name"), F.lit("valuesLimitReached").alias("path_expr"), empty_map().alias("tags"), "start", "stop", "step", F.lit("average").alias("cons_func"), F.lit(0.0).alias("xff"), empty_map().alias("opts"))
        grid = series.select("sid", F.explode(F.sequence(F.col("start"), F.col("stop") - F.col("step"), F.col("step"))).alias("ts"))
        return SeriesFrame(series, grid.withColumn("v", F.lit(0.0)), f.step)
    made = few.withColumn("__k", F.lit(1)).join(span.withColumn("__k", F.lit(1)), "__k")
    name = F.col("k").cast("string")
    series = renumber(made.select(F.xxhash64("k").alias("sid"), F.lit(0).alias("ord"), name.alias("name"), name.alias("path_expr"), empty_map().alias("tags"), "start", "stop", "step", F.lit("average").alias("cons_func"), F.lit(0.0).alias("xff"), empty_map().alias("opts"), "k"), F.col("k"))
    grid = series.select("sid", "k", F.explode(F.sequence(F.col("start"), F.col("stop") - F.col("step"), F.col("step"))).alias("ts"))
    points = grid.join(counts, ["k", "ts"], "left").select("sid", "ts", F.coalesce(V(), F.lit(0.0)).alias("v"))
    return SeriesFrame(series.drop("k"), points, f.step)


@register("weightedAverage", group="Combine", args="seriesListAvg, seriesListWeight, *nodes")
def weighted_average(ctx, a: Args) -> SeriesFrame:
    """The sum of values times weights over the sum of weights; values and weights meet by path nodes."""
    avg, weight = align.common(a.series(0)), align.common(a.series(1))
    key = node_key(a.nodes(2))

    def last(f: SeriesFrame, name: str) -> DataFrame:
        dims = f.series.withColumn("key", key).groupBy("key").agg(F.max_by("sid", "ord").alias("sid"))
        return f.points.join(dims, "sid").select("key", "ts", F.col("v").alias(name))

    both = last(avg, "a").join(last(weight, "w"), ["key", "ts"], "full")
    value = F.try_divide(F.sum(F.col("a") * F.col("w")), F.sum("w"))
    sums = both.groupBy("ts").agg(value.alias("v"))
    one = grouped(avg, F.lit(0), _fold("sum"), F.lit(f"weightedAverage({_arg_text(a)})"))
    # the one series of the result is the group of key 0
    return one.with_points(sums.select(F.xxhash64(F.lit(0)).alias("sid"), "ts", "v"))


def _divide(num: DataFrame, den: DataFrame, on: list[str]) -> DataFrame:
    return num.join(den, on, "left").select("sid", "ts", F.try_divide("v", "d").alias("v"))


@register("divideSeries", group="Combine", args="dividendSeriesList, divisorSeries")
def divide_series(ctx, a: Args) -> SeriesFrame:
    """Each series divided by the one divisor; absent for 0. With one argument: its first series by its second."""
    if len(a) == 1:
        both = align.common(a.series(0))
        top, bottom = both.keep(both.series.where("ord = 1")), both.keep(both.series.where("ord = 2"))
        if both.series.limit(3).count() != 2:
            raise EvalError("divideSeries: one argument must be two series")
        shown = None
    else:
        top, bottom, shown = align.common(a.series(0)), align.common(a.series(1)), a.node.args[1].text
        n = bottom.series.limit(2).count()
        if n > 1:
            raise EvalError("divideSeries: the divisor must be one series")
        if n == 0:
            return top.map(NULL()).call("divideSeries", "MISSING")
    if top.step != bottom.step:
        step = _lcm(top, bottom)
        top, bottom = align.to_step(top, step), align.to_step(bottom, step)
    points = _divide(top.points, bottom.points.select("ts", F.col("v").alias("d")), ["ts"])
    out = top.with_points(points)
    return out.rename(F.lit(f"divideSeries({a.node.args[0].text})")) if shown is None else out.call("divideSeries", shown)


def _lcm(*frames: SeriesFrame) -> int:
    import math

    return math.lcm(*(align.lcm_step(f) for f in frames))


_MISSING = "MISSING"


def _with_total(ctx, f: SeriesFrame, total: DataFrame, on: list[str], name: Column) -> SeriesFrame:
    """Each value as a share of its total, `total` having the columns `on` and `d`."""
    points = f.points if on == ["ts"] else f.joined("key")
    d = F.when(F.col("d") != 0, F.col("d"))
    shares = points.join(total, on, "left").select("sid", "ts", (V() * (F.lit(100.0) / d)).alias("v"))
    return f.with_points(shares).rename(name)


@register("asPercent", "pct", group="Combine", args="seriesList, total=None, *nodes")
def as_percent(ctx, a: Args) -> SeriesFrame:
    """Values as percentages of a total: of the list's own sum, a constant, one series, matched series, or by groups."""
    f = align.common(a.series(0))
    name = F.col("name")
    total = a.get(1, "total")
    nodes = a.nodes(2)
    absent = total is None or (total.kind == "name" and str(total.value).lower() == "none")
    if nodes:
        key = node_key(nodes)
        mine = f.with_series(f.series.withColumn("key", key))
        if absent:
            sums = mine.joined("key").groupBy("key", "ts").agg(F.sum("v").alias("d"))
            out = _with_total(ctx, mine, sums, ["key", "ts"], F.concat(F.lit("asPercent("), name, F.lit(",None)")))
        else:
            other = align.common(a.series(1))
            keyed = other.with_series(other.series.withColumn("key", key))
            sums = keyed.joined("key").groupBy("key", "ts").agg(F.sum("v").alias("d"))
            per = keyed.series.groupBy("key").agg(F.when(F.count(F.lit(1)) == 1, F.min("name")).otherwise(F.concat(F.lit("sumSeries("), F.array_join(F.sort_array(F.collect_list("name")), ","), F.lit(")"))).alias("tname"))
            mine = mine.with_series(mine.series.join(per, "key", "left"))
            shown = F.concat(F.lit("asPercent("), name, F.lit(","), F.coalesce("tname", F.lit(_MISSING)), F.lit(")"))
            out = _with_total(ctx, mine, sums, ["key", "ts"], shown)
            # totals whose key no series has
            lone = keyed.series.join(mine.series.select("key"), "key", "left_anti")
            rest = keyed.keep(lone).map(NULL()).rename(F.concat(F.lit(f"asPercent({_MISSING},"), name, F.lit(")")))
            return concat([_plain(out), _plain(rest)])
        return _plain(out)
    if absent:
        sums = f.points.groupBy("ts").agg(F.sum("v").alias("d"))
        return _with_total(ctx, f, sums, ["ts"], F.concat(F.lit("asPercent("), name, F.lit(")")))
    if total.kind == "number":
        t = float(total.value)
        out = f.map(V() * F.lit(100.0 / t) if t else NULL())
        return out.rename(F.concat(F.lit("asPercent("), name, F.lit(f",{total.text})")))
    other = align.common(a.series(1))
    size = other.series.limit(2).count()
    if size == 0:
        raise EvalError("asPercent: the total has no series")
    if size == 1:
        return _with_total(ctx, f, other.points.select("ts", F.col("v").alias("d")), ["ts"], F.concat(F.lit("asPercent("), name, F.lit(f",{total.text})")))
    # lists side by side, each in order of names
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name", "ord"))
    mine = f.with_series(f.series.withColumn("key", place))
    theirs = other.with_series(other.series.withColumn("key", place))
    names = theirs.series.select("key", F.col("name").alias("tname"))
    mine = mine.with_series(mine.series.join(names, "key", "left"))
    shown = F.concat(F.lit("asPercent("), name, F.lit(","), F.coalesce("tname", F.lit(_MISSING)), F.lit(")"))
    out = _with_total(ctx, mine, theirs.joined("key").select("key", "ts", F.col("v").alias("d")), ["key", "ts"], shown)
    lone = theirs.series.join(mine.series.select("key"), "key", "left_anti")
    rest = theirs.keep(lone).map(NULL()).rename(F.concat(F.lit(f"asPercent({_MISSING},"), name, F.lit(")")))
    return concat([_plain(out), _plain(rest)])


def _plain(f: SeriesFrame) -> SeriesFrame:
    from ..model import SERIES

    return f.with_series(f.series.select(*SERIES))


@register("aggregateSeriesLists", group="Combine", args="seriesListFirstPos, seriesListSecondPos, func, xFilesFactor=None")
def aggregate_series_lists(ctx, a: Args) -> SeriesFrame:
    """Two lists of one length, folded place by place."""
    func, xff = a.string(2, "func"), a.number(3, "xFilesFactor", None)
    first, second = align.common(a.series(0)), align.common(a.series(1))
    both = concat([first.with_series(first.series.withColumn("path_expr", F.col("ord").cast("string"))), second.with_series(second.series.withColumn("path_expr", F.col("ord").cast("string")))])
    names = both.series.groupBy("path_expr").agg(F.min_by("name", "ord").alias("n1"), F.max_by("name", "ord").alias("n2"))
    out = grouped(both, F.col("path_expr"), _fold(func), F.col("key"), xff)
    shown = F.concat(F.lit(f"{func}Series("), F.col("n1"), F.lit(","), F.col("n2"), F.lit(")"))
    series = out.series.join(names.withColumnRenamed("path_expr", "name"), "name").withColumn("name", shown).drop("n1", "n2")
    return out.with_series(series)


_PAIRS = {
    "divideSeriesLists": lambda x, y: F.try_divide(x, y),
    "diffSeriesLists": lambda x, y: x - y,
    "multiplySeriesLists": lambda x, y: x * y,
    "powSeriesLists": lambda x, y: F.pow(x, y),
    "sumSeriesLists": lambda x, y: x + y,
}
_PAIR_NAMES = {"divideSeriesLists": "divideSeries", "diffSeriesLists": "diffSeries", "multiplySeriesLists": "multiplySeries", "powSeriesLists": "powSeries", "sumSeriesLists": "sumSeries"}


@register(*_PAIRS, group="Combine", args="firstSeriesList, secondSeriesList, default=None, matching=False")
def series_lists(ctx, a: Args) -> SeriesFrame:
    """Two lists, each in order of names, combined pair by pair: by place, or by name where the sizes differ.

    One series on the right meets all on the left; `default` stands for a side
    that is missing or absent.
    """
    first, second = align.common(a.series(0)), align.common(a.series(1))
    default, matching = a.number(2, "default", None), a.boolean(3, "matching", False)
    n1, n2 = first.series.count(), second.series.count()
    by_name = matching or (n1 != n2 and n2 != 1)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name", "ord")).cast("string")
    key = F.col("name") if by_name else (place if n2 != 1 or n1 == 1 else F.lit("1"))
    one = first.with_series(first.series.withColumn("key", key))
    two = second.with_series(second.series.withColumn("key", F.col("name") if by_name else place))
    names = two.series.select("key", F.col("name").alias("other"))
    one = one.with_series(one.series.join(names, "key", "left" if default is not None else "inner"))
    d = two.joined("key").select("key", "ts", F.col("v").alias("d"))
    x, y = V(), F.col("d")
    if default is not None:
        some = V().isNotNull() | F.col("d").isNotNull()
        x, y = F.when(some, F.coalesce(V(), F.lit(default))), F.when(some, F.coalesce(F.col("d"), F.lit(default)))
    out = _PAIRS[a.fn](x, y)
    points = one.joined("key").join(d, ["key", "ts"], "left").select("sid", "ts", F.nanvl(F.when(F.abs(out) != float("inf"), out), NULL()).alias("v"))
    shown = F.concat(F.lit(_PAIR_NAMES[a.fn] + "("), F.col("name"), F.lit(","), F.coalesce("other", F.lit(str(default))), F.lit(")"))
    return _plain(one.with_points(points).rename(shown))


@register("heatMap", group="Combine")
def heat_map(ctx, a: Args) -> SeriesFrame:
    """The differences of neighbours, the series in order of their sums over the first five times at which all are present."""
    f = a.series(0)
    n = f.series.count()
    whole = f.points.groupBy("ts").agg(F.count("v").alias("c")).where(F.col("c") == n).orderBy("ts").limit(5).select("ts")
    sums = f.points.join(F.broadcast(whole), "ts").groupBy("sid").agg(F.sum("v").alias("s"))  # five rows
    ranked = renumber(f.series.join(sums, "sid", "left"), F.col("s"), F.col("ord")).drop("s")
    w = Window.partitionBy("ts").orderBy("ord")
    rows = f.points.join(ranked.select("sid", "ord"), "sid").select("sid", "ord", "ts", (V() - F.lag("v").over(w)).alias("v"))
    before = F.lag("name").over(Window.partitionBy(F.lit(0)).orderBy("ord"))
    series = ranked.withColumn("name", F.concat(F.lit("heatMap("), F.col("name"), F.lit(","), before, F.lit(")"))).where("ord > 1").withColumn("ord", F.col("ord") - 1)
    return SeriesFrame(series, rows.where("ord > 1").select("sid", "ts", "v"), f.step)


@register("reduceSeries", "reduce", group="Combine", args="seriesLists, reduceFunction, reduceNode, *reduceMatchers")
def reduce_series(ctx, a: Args) -> SeriesFrame:
    """Groups of series that differ in one node; the members named by the matchers, in order, go to a function."""
    f, func, node = a.series(0), a.string(1, "reduceFunction"), a.integer(2, "reduceNode")
    matchers = [str(n.value) for n in a.node.args[3:]]
    if not matchers:
        raise EvalError("reduceSeries needs matchers")
    path = nodes_of(F.col("name"))
    if few(f.series.where(F.size(path) < (node + 1 if node >= 0 else -node)).limit(1), "names"):
        raise EvalError(f"reduceSeries: a name has no node {node}")
    place_of = F.lit(node) if node >= 0 else F.size(path) + node
    at = F.transform(path, lambda x, i: F.when(i == place_of, F.lit(f"reduce.{func}")).otherwise(x))
    dims = f.series.withColumn("key", F.array_join(at, ".")).withColumn("member", F.try_element_at(path, F.lit(node + 1 if node >= 0 else node)))
    place = reduce(lambda acc, im: acc.when(F.col("member") == im[1], im[0]), list(enumerate(matchers, 1))[1:], F.when(F.col("member") == matchers[0], 1))
    picked = dims.withColumn("ord2", place.cast("int")).where(F.col("ord2").isNotNull())
    full = picked.groupBy("key").agg(F.count_distinct("ord2").alias("c")).where(F.col("c") == len(matchers)).select("key")
    picked = picked.join(full, "key", "left_semi")
    order = picked.groupBy("key").agg(F.min("ord").alias("g"))
    picked = picked.join(order, "key")
    part = f.keep(picked).with_series(picked)
    bare = func.removesuffix("Series")
    tables = {"asPercent": lambda x, y: F.when(y != 0, x * (F.lit(100.0) / y)), "divideSeries": lambda x, y: F.try_divide(x, y), "divide": lambda x, y: F.try_divide(x, y), "pct": lambda x, y: F.when(y != 0, x * (F.lit(100.0) / y))}
    if func in tables:
        how = lambda v, _: tables[func](F.max(F.when(F.col("m") == 1, v)), F.max(F.when(F.col("m") == 2, v)))
    elif bare in aggs.FOLDS:
        how = lambda v, _: aggs.fold(bare, v, F.col("m"))
    elif func in REGISTRY:
        return _reduce_by(ctx, f, picked, func, len(matchers))
    else:
        raise EvalError(f"unknown function {func}")
    sid = F.xxhash64("key")
    series = renumber(
        with_common_tags(picked.groupBy("key").agg(F.min("g").alias("ord"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("step").alias("step"), F.min_by("cons_func", "ord2").alias("cons_func"), F.min_by("xff", "ord2").alias("xff")), picked)
        .select(sid.alias("sid"), "ord", F.col("key").alias("name"), F.col("key").alias("path_expr"), "tags", "start", "stop", "step", "cons_func", "xff", empty_map().alias("opts")),
        F.col("ord"),
    )
    rows = part.points.join(picked.select("sid", "key", F.col("ord2").alias("m")), "sid")
    points = rows.groupBy("key", "ts").agg(how(V(), None).alias("v")).select(sid.alias("sid"), "ts", "v")
    return SeriesFrame(series, points, f.step)


def _reduce_by(ctx, f: SeriesFrame, picked: DataFrame, func: str, size: int) -> SeriesFrame:
    """Any other function over the members of each group, as an expression per group."""
    frames = []
    for row in few(picked.groupBy("key").agg(F.min("g").alias("g")).orderBy("g"), f"groups for {func}"):
        names = [f"{row['key']}#{m}" for m in range(1, size + 1)]
        group = picked.where(F.col("key") == row["key"])
        parts = {n: _plain(f.keep(group.where(F.col("ord2") == m)).with_series(group.where(F.col("ord2") == m).withColumn("ord", F.lit(1)))) for m, n in enumerate(names, 1)}
        out = ctx.bind(**parts).eval(call(func, tuple(Node("name", n, n) for n in names)))
        frames.append(out.rename(F.lit(row["key"])))
    return concat(frames) if frames else ctx.empty()


@register("mapSeries", "map", group="Combine", args="seriesList, *mapNodes")
def map_series(ctx, a: Args) -> SeriesFrame:
    """The list with the members of each node key side by side, keys in order of first appearance."""
    f = a.series(0)
    keyed = f.series.withColumn("key", node_key(a.nodes(1)))
    first = F.min("ord").over(Window.partitionBy("key"))
    return f.with_series(renumber(keyed.withColumn("g", first), F.col("g"), F.col("ord")).drop("g", "key"))


__all__ = ["at_ranks", "grouped", "inner_metric"]
