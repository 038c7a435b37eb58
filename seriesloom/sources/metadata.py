"""Queries over the catalogue alone: find, expand, tags, info."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import natural_key

from .base import SeriesSource
from .globs import glob_regex


def _level(source: SeriesSource, pattern: str) -> DataFrame:
    """`path, leaf` of the tree nodes that a pattern selects; hidden _tag nodes are left out."""
    depth = pattern.count(".") + 1
    nodes = F.split("path", r"\.")
    rows = source.catalogue().where(F.size(nodes) >= depth).select(F.array_join(F.slice(nodes, 1, depth), ".").alias("path"), (F.size(nodes) == depth).alias("leaf"))
    return rows.where(F.col("path").rlike(f"^{glob_regex(pattern)}$") & ~F.col("path").startswith("_tag")).distinct()


def find(source: SeriesSource, pattern: str) -> DataFrame:
    """`id, text string, leaf, expandable, allow_children int`: one row per node of the tree; a path can be leaf and branch.

    Branches come first, each kind in natural order of its paths.
    """
    rows = _level(source, pattern)
    branch = (~F.col("leaf")).cast("int")
    return rows.select(
        F.col("path").alias("id"), F.element_at(F.split("path", r"\."), -1).alias("text"), F.col("leaf").cast("int").alias("leaf"), branch.alias("expandable"), branch.alias("allow_children")
    ).orderBy("leaf", natural_key(F.col("id")), "id")


def find_tree(source: SeriesSource, pattern: str) -> DataFrame:
    """find() as rows of a tree view: `id, text, leaf, expandable, allow_children`, one per text; a branch hides the leaf of its name."""
    rows = find(source, pattern)
    first = F.row_number().over(Window.partitionBy("id").orderBy("leaf"))
    return rows.withColumn("k", first).where("k = 1").drop("k").orderBy("leaf", natural_key(F.col("id")), "id")


def complete(source: SeriesSource, pattern: str) -> DataFrame:
    """`path, name string, is_leaf int`: find() as a completer shows it; a branch's path ends with a dot."""
    rows = find(source, pattern)
    shown = F.when(F.col("leaf") == 1, F.col("id")).otherwise(F.concat("id", F.lit(".")))
    return rows.select(shown.alias("path"), F.col("text").alias("name"), F.col("leaf").alias("is_leaf"))


def expand(source: SeriesSource, patterns: list[str], leaves_only: bool = False, group_by_query: bool = False) -> DataFrame:
    """`path` (with `query` where grouped) of all patterns, each once."""
    parts = []
    for p in patterns:
        rows = _level(source, p)
        if leaves_only:
            rows = rows.where("leaf")
        parts.append(rows.select(F.lit(p).alias("query"), "path").distinct())
    every = reduce(DataFrame.unionByName, parts)
    return every.orderBy("query", natural_key(F.col("path"))) if group_by_query else every.select("path").distinct().orderBy(natural_key(F.col("path")))


def tag_names(source: SeriesSource, prefix: str = "", limit: int | None = None) -> DataFrame:
    """`tag`: the tag names with a prefix, in order; `limit` of them at most."""
    rows = source.catalogue().select(F.explode(F.map_keys("tags")).alias("tag")).where(F.col("tag").startswith(prefix)).distinct().orderBy("tag")
    return rows.limit(limit) if limit is not None else rows


def tag_values(source: SeriesSource, tag: str, prefix: str = "", limit: int | None = None) -> DataFrame:
    """`value`: the values of a tag with a prefix, in order; `limit` of them at most."""
    value = F.try_element_at("tags", F.lit(tag))
    rows = source.catalogue().select(value.alias("value")).where(F.col("value").isNotNull() & F.col("value").startswith(prefix)).distinct().orderBy("value")
    return rows.limit(limit) if limit is not None else rows


def info(source: SeriesSource, pattern: str) -> DataFrame:
    """`name, cons_func, xff, step, max_retention, number_of_points` of the series whose path a pattern selects.

    A series is kept at one step, so it has one retention: so many seconds, as so
    many points; null where a source keeps what it has.
    """
    rows = source.catalogue().where(F.col("path").rlike(f"^{glob_regex(pattern)}$"))
    return rows.select("name", "cons_func", "xff", "step", F.col("retention").alias("max_retention"), F.expr("retention div step").alias("number_of_points")).distinct()
