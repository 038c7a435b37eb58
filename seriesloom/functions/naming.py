"""Names, tags and legends: projections of the series table."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NAME, SeriesFrame, TS, V, inner_metric, node_key, nodes_of
from . import aggs
from .registry import Args, EvalError, few, fmt, register



def _back_references(text: str) -> str:
    """\\1 as $1; other dollars stay themselves."""
    return re.sub(r"\\(\d+)", r"$\1", text.replace("$", r"\$"))


@register("alias", group="Alias", args="seriesList, newName")
def alias(ctx, a: Args) -> SeriesFrame:
    """One name for all series; ${name} and ${tag} are filled in where formats are allowed."""
    text, f = a.string(1, "newName"), a.series(0)
    if not ctx.engine.format_alias or "${" not in text:
        return f.rename(F.lit(text))
    parts = []
    for lit, key in re.findall(r"([^$]+|\$(?!\{))|\$\{([^}]*)\}", text):
        parts.append(F.lit(lit) if lit else NAME() if key == "name" else F.coalesce(F.try_element_at("tags", F.lit(key)), F.lit("")))
    return f.rename(F.concat(*parts))


@register("aliasByNode", "aliasByTags", group="Alias", args="seriesList, *nodes")
def alias_by_node(ctx, a: Args) -> SeriesFrame:
    """Path nodes and tag values, joined by dots."""
    nodes = a.nodes(1)
    if not nodes:
        raise EvalError(f"{a.fn} needs a node or a tag")
    return a.series(0).rename(node_key(nodes))


@register("aliasByMetric", group="Alias")
def alias_by_metric(ctx, a: Args) -> SeriesFrame:
    """The last path node."""
    return a.series(0).rename(F.element_at(nodes_of(NAME()), -1))


@register("aliasSub", group="Alias", args="seriesList, search, replace")
def alias_sub(ctx, a: Args) -> SeriesFrame:
    """Names with the matches of a regular expression replaced."""
    return a.series(0).rename(F.regexp_replace(NAME(), a.string(1, "search"), _back_references(a.string(2, "replace"))))


_FORMAT = re.compile(r"%([-+ 0#]*)(\d*)(?:\.(\d+))?([dfgevs%])")


@register("aliasQuery", group="Alias", args="seriesList, search, replace, newName")
def alias_query(ctx, a: Args) -> SeriesFrame:
    """Names rewritten to other queries, whose last values are put into a format."""
    f = a.series(0)
    search, replace, form = a.string(1, "search"), a.string(2, "replace"), a.string(3, "newName")
    target = F.regexp_replace(NAME(), search, _back_references(replace))
    # one query per name: as many as the list has series
    names = [r[0] for r in few(f.series.select(target).distinct(), "queries for aliasQuery")]
    out = None
    for name in names:
        got = ctx.eval(name)
        last = got.points.join(got.series.where("ord = 1").select("sid"), "sid").groupBy(F.lit(name).alias("q")).agg(aggs.last_present(V(), TS()).alias("last"))
        out = last if out is None else out.unionByName(last)
    if out is None:
        return f
    m = _FORMAT.search(form)
    spec = f"%{m.group(1)}{m.group(2)}{'.' + m.group(3) if m.group(3) else ''}{m.group(4)}" if m else ""
    if m and m.group(4) in "dv":
        spec = spec[:-1] + "d"
    x = F.col("last").cast("long") if spec.endswith("d") else F.col("last")
    shown = F.format_string(form.replace(m.group(), spec) if m else form, x) if m else F.lit(form)
    series = f.series.withColumn("q", target).join(out, "q", "left").withColumn("name", F.when(F.col("last").isNotNull(), shown).otherwise(NAME())).drop("q", "last")
    return f.with_series(series)


@register("aliasByBase64", group="Alias", args="seriesList, nodeNum=None")
def alias_by_base64(ctx, a: Args) -> SeriesFrame:
    """The name, or its n-th node (from 1), decoded from base64."""
    f, n = a.series(0), a.integer(1, "nodeNum", None)
    if n is None:
        return f.rename(F.coalesce(F.expr("try_to_binary(name, 'base64')").cast("string"), NAME()))
    node = F.try_element_at(nodes_of(NAME()), F.lit(n))
    return f.with_series(f.series.withColumn("__n", node).withColumn("name", F.coalesce(F.expr("try_to_binary(__n, 'base64')").cast("string"), NAME())).drop("__n"))


def _lookup(ctx, a: Args, name: str):
    if name not in ctx.engine.lookups:
        raise EvalError(f"{a.fn}: no lookup table {name}")
    return ctx.engine.lookups[name]


@register("aliasByRedis", group="Alias", args="seriesList, keyName, keepPath=False")
def alias_by_redis(ctx, a: Args) -> SeriesFrame:
    """The last node looked up in a table of `key, value`; nodes that are not there stay."""
    table = _lookup(ctx, a, a.string(1, "keyName")).select(F.col("key").alias("__k"), F.col("value").alias("__v")).dropDuplicates(["__k"])
    f, keep = a.series(0), a.boolean(2, "keepPath", False)
    nodes = nodes_of(NAME())
    head = F.array_join(F.slice(nodes, F.lit(1), F.size(nodes) - 1), ".")
    new = F.when(F.lit(keep) & (head != ""), F.concat(head, F.lit("."), F.col("__v"))).otherwise(F.col("__v"))
    met = f.series.withColumn("__k", F.element_at(nodes, -1)).join(table, "__k", "left")
    return f.with_series(met.withColumn("name", F.coalesce(new, NAME())).drop("__k", "__v"))


@register("aliasByPostgres", group="Alias", args="seriesList, table, *nodes")
def alias_by_postgres(ctx, a: Args) -> SeriesFrame:
    """The listed nodes, joined by dots, looked up in a table of `key, value` (read over JDBC, for example)."""
    table = _lookup(ctx, a, a.string(1)).select(F.col("key").cast("string").alias("__k"), F.col("value").cast("string").alias("__v")).dropDuplicates(["__k"])
    f = a.series(0)
    met = f.series.withColumn("__k", node_key(a.nodes(2))).join(table, "__k", "left")
    return f.with_series(met.withColumn("name", F.coalesce("__v", NAME())).drop("__k", "__v"))


@register("substr", group="Special", args="seriesList, start=0, stop=0")
def substr(ctx, a: Args) -> SeriesFrame:
    """Path nodes from start to stop (0: the end), negative ones from the end."""
    f, i, j = a.series(0), a.integer(1, "start", 0), a.integer(2, "stop", 0)
    nodes = nodes_of(NAME())
    n = F.size(nodes)
    begin = F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    end = n if j == 0 else F.least(F.lit(j), n) if j > 0 else n + j
    return f.rename(F.array_join(F.slice(nodes, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")), "."))


def _case(a: Args, change) -> SeriesFrame:
    f = a.series(0)
    at = [int(n) for n in a.nodes(1)]
    if not at:
        return f.rename(change(NAME()))
    out = NAME()
    for k in at:
        pos = F.lit(k + 1) if k >= 0 else F.length(NAME()) + k + 1
        out = F.when((pos >= 1) & (pos <= F.length(NAME())), F.overlay(out, change(F.substring(out, pos, F.lit(1))), pos, F.lit(1))).otherwise(out)
    return f.rename(out)


@register("lower", "toLowerCase", group="Alias", args="seriesList, *pos")
def lower(ctx, a: Args) -> SeriesFrame:
    """Names, or the characters at some places, in lower case."""
    return _case(a, F.lower)


@register("upper", "toUpperCase", group="Alias", args="seriesList, *pos")
def upper(ctx, a: Args) -> SeriesFrame:
    """Names, or the characters at some places, in upper case."""
    return _case(a, F.upper)


def with_unit(v: Column, system: str) -> Column:
    """A value shortened by a unit prefix: si by 1000, binary by 1024."""
    steps = [(10.0 ** (3 * k), p) for k, p in ((5, "P"), (4, "T"), (3, "G"), (2, "M"), (1, "K"))] if system == "si" else [(1024.0**k, p + "i") for k, p in ((5, "P"), (4, "T"), (3, "G"), (2, "M"), (1, "K"))]
    out = None
    for size, p in steps:
        shown = F.concat(F.format_string("%.2f", v / F.lit(size)), F.lit(p))
        out = F.when(F.abs(v) >= size, shown) if out is None else out.when(F.abs(v) >= size, shown)
    return out.otherwise(F.format_string("%.2f", v))


@register("legendValue", group="Alias", args="seriesList, *valueTypes")
def legend_value(ctx, a: Args) -> SeriesFrame:
    """Aggregates appended to the name; `si` or `binary` as the last type shortens them."""
    f = a.series(0)
    kinds = [str(n.value) for n in a.node.args[1:]]
    system = kinds.pop() if kinds and kinds[-1] in ("si", "binary") else None
    sums = f.points.groupBy("sid").agg(*(aggs.summarise(aggs.known_summary(k), V(), TS()).alias(f"__{i}") for i, k in enumerate(kinds)))
    series = f.series.join(sums, "sid", "left")
    parts = []
    for i, k in enumerate(kinds):
        x = F.col(f"__{i}")
        shown = with_unit(x, system) if system else F.format_string("%.6f", x)
        parts.append(F.concat(F.lit(f" ({k}: "), F.coalesce(shown, F.lit("None")), F.lit(")")))
    return f.with_series(series.withColumn("name", F.concat(NAME(), *parts)).drop(*(f"__{i}" for i in range(len(kinds)))))


@register("cactiStyle", group="Special", args="seriesList, system=None, units=None")
def cacti_style(ctx, a: Args) -> SeriesFrame:
    """Current, maximum and minimum appended to the name in columns."""
    f, system, unit = a.series(0), a.string(1, "system", ""), a.string(2, "units", "")
    if system not in ("", "si", "binary"):
        raise EvalError(f"cactiStyle: unknown system {system}")
    sums = f.points.groupBy("sid").agg(aggs.last_present(V(), TS()).alias("__c"), F.max("v").alias("__x"), F.min("v").alias("__n"))

    def shown(c: str) -> Column:
        text = with_unit(F.col(c), system) if system else F.format_string("%.2f", F.col(c))
        return F.rpad(F.concat(F.coalesce(text, F.lit("None")), F.lit(f" {unit}" if unit else "")), 12, " ")

    name = F.concat(NAME(), F.lit(" Current:"), shown("__c"), F.lit(" Max:"), shown("__x"), F.lit(" Min:"), shown("__n"))
    return f.with_series(f.series.join(sums, "sid", "left").withColumn("name", F.rtrim(name)).drop("__c", "__x", "__n"))


@register("aggregateLine", group="Calculate", args="seriesList, func='average', keepStep=False")
def aggregate_line(ctx, a: Args) -> SeriesFrame:
    """A level line at an aggregate of each series; over the whole grid, or two points."""
    f, func, keep = a.series(0), aggs.known_summary(a.string(1, "func", "average")), a.boolean(2, "keepStep", False)
    sums = f.points.groupBy("sid").agg(aggs.summarise(func, V(), TS()).alias("k"))
    series = f.series.join(sums, "sid", "left")
    shown = F.concat(F.lit("aggregateLine("), NAME(), F.lit(","), F.coalesce(F.format_string("%.6g", "k"), F.lit("None")), F.lit(")"))
    if keep:
        points = f.points.join(sums, "sid").select("sid", "ts", F.col("k").alias("v"))
        return SeriesFrame(series.withColumn("name", shown).drop("k"), points, f.step)
    step = F.col("stop") - F.col("start")
    points = series.select("sid", F.explode(F.array(F.col("start"), F.col("stop"))).alias("ts"), F.col("k").alias("v"))
    return SeriesFrame(series.withColumns({"name": shown, "step": step}).withColumn("stop", F.col("stop") + F.col("step")).drop("k"), points, None)


@register("nPercentile", group="Calculate", args="seriesList, n")
def n_percentile(ctx, a: Args) -> SeriesFrame:
    """A level line at a percentile of each series."""
    p, f = a.number(1, "n"), a.series(0)
    sums = f.points.groupBy("sid").agg(aggs.percentile(V(), p).alias("k"))
    return f.with_points(f.points.join(sums, "sid").select("sid", "ts", F.col("k").alias("v"))).call(a.fn, fmt(p))


__all__ = ["inner_metric"]
