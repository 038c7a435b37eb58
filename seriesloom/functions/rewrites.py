"""Calls that become other expressions, planned over the same range."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import nodes_of
from .naming import _back_references
from .registry import Args, few, rewrite


@rewrite("applyByNode")
def apply_by_node(ctx, a: Args) -> list[str]:
    """A template for each prefix of the series' paths up to a node, % standing for the prefix.

    Prefixes are asked for before the rest is planned; they are as many as the
    tree has nodes at that level.
    """
    f, n = a.series(0), a.integer(1, "nodeNum")
    template, name = a.string(2, "templateFunction"), a.string(3, "newName", None)
    nodes = nodes_of(F.col("name"))
    prefix = F.array_join(F.slice(nodes, 1, n + 1), ".")
    rows = few(f.series.where(F.size(nodes) > n).groupBy(prefix.alias("p")).agg(F.min("ord").alias("o")).orderBy("o"), "prefixes for applyByNode")
    out = []
    for r in rows:
        t = template.replace("%", r["p"])
        out.append(f"alias({t},'{name.replace('%', r['p'])}')" if name else t)
    return out


@rewrite("useSeriesAbove", "aboveSeries")
def use_series_above(ctx, a: Args) -> list[str]:
    """Other series, named by a regular expression, for each series whose maximum is above a value."""
    f, x = a.series(0), a.number(1, "value")
    search, replace = a.string(2, "search"), a.string(3, "replace")
    high = f.points.groupBy("sid").agg(F.max("v").alias("m")).where(F.col("m") > x)
    names = f.series.join(high, "sid").orderBy("ord").select(F.regexp_replace("name", search, _back_references(replace)))
    return [r[0] for r in few(names, f"series for {a.fn}")]
