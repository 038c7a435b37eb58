"""Aggregates by name, as columns.

Two dispatchers, as the language has them. `fold` is used across series and when
points are merged; `summarise` by buckets, sorting and legends. Both skip absent
values; they differ in avg_zero, diff, multiply and in the names they know.
`order` is a column that puts the values in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import EvalError

FOLDS = (
    "average", "avg", "avg_zero", "count", "diff", "max", "maximum", "min", "minimum", "sum", "total",
    "first", "last", "current", "median", "multiply", "range", "rangeOf", "stddev",
)
SUMMARIES = ("sum", "total", "avg", "average", "avg_zero", "max", "min", "last", "current", "range", "rangeOf", "median", "multiply", "diff", "count", "stddev", "first")
_PERCENT = re.compile(r"p(\d+(?:\.\d+)?)\Z")


def _first_present(v: Column, order: Column) -> Column:
    return F.min_by(v, F.when(v.isNotNull(), order))


def last_present(v: Column, order: Column) -> Column:
    return F.max_by(v, F.when(v.isNotNull(), order))


def rows(v: Column) -> Column:
    return F.count(F.lit(1))


def product(v: Column) -> Column:
    """The product of present values."""
    return F.product(v)


def percentile(v: Column, percent: float) -> Column:
    """Interpolated between neighbours; absent outside 0..100."""
    if not 0 <= percent <= 100:
        return F.max(F.lit(None).cast("double"))
    return F.percentile(v, F.lit(percent / 100.0))


def order_values(values: DataFrame, *places: Callable[[Column], Column], cuts: int = 200) -> DataFrame:
    """One row `r0, r1, ...`: of all values `v`, in order, those at given places; a place is an expression of their number, from 0.

    Values are counted, the counts cut into `cuts` stretches at approximate
    quantiles, and added up within each, so that no task sorts all of them; the
    result is exact.
    """
    counts = values.where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    marks = values.agg(F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 1000).alias("marks")).withColumn("__k", F.lit(1))
    placed = counts.withColumn("__k", F.lit(1)).join(F.broadcast(marks), "__k")  # one row
    placed = placed.select("v", "c", F.size(F.filter("marks", lambda m: m < F.col("v"))).alias("part"))
    sums = placed.groupBy("part").agg(F.sum("c").alias("c"))
    all_ = Window.partitionBy(F.lit(0))  # over `cuts` rows
    before = sums.select("part", (F.sum("c").over(all_.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(all_).alias("n"))
    run = placed.join(F.broadcast(before), "part")
    to = F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    run = run.select("v", to.alias("to"), "n")
    return run.agg(*(F.min(F.when(F.col("to") > place(F.col("n")), F.col("v"))).alias(f"r{i}") for i, place in enumerate(places)))


def ceil_place(percent: float) -> Callable[[Column], Column]:
    """The place ceil((n-1)p/100) among n values; beyond them for other percents."""
    return lambda n: F.ceil((n - 1) * F.lit(percent) / F.lit(100.0)) if 0 <= percent <= 100 else n


def fold(name: str, v: Column, order: Column) -> Column:
    """An aggregate over the series of a list, in list order."""
    n = F.count(v)
    table = {
        "average": lambda: F.avg(v),
        "avg": lambda: F.avg(v),
        "avg_zero": lambda: F.sum(v) / rows(v),
        "count": lambda: F.when(n > 0, n.cast("double")),
        "diff": lambda: 2 * _first_present(v, order) - F.sum(v),
        "max": lambda: F.max(v),
        "maximum": lambda: F.max(v),
        "min": lambda: F.min(v),
        "minimum": lambda: F.min(v),
        "sum": lambda: F.sum(v),
        "total": lambda: F.sum(v),
        "first": lambda: F.min_by(v, order),
        "last": lambda: last_present(v, order),
        "current": lambda: last_present(v, order),
        "median": lambda: F.percentile(v, F.lit(0.5)),
        "multiply": lambda: F.when(n == rows(v), product(v)),
        "range": lambda: F.max(v) - F.min(v),
        "rangeOf": lambda: F.max(v) - F.min(v),
        "stddev": lambda: F.stddev_pop(v),
    }
    if name not in table:
        raise EvalError(f"unsupported aggregate {name}")
    return table[name]()


def summarise(name: str, v: Column, order: Column, xff: Column | float | None = None) -> Column:
    """An aggregate over the values of one series; absent where fewer than `xff` of them are present."""
    n = F.count(v)
    if name in ("avg", "average", "avg_zero"):
        out = F.avg(v)
    elif name == "diff":
        # the oldest value stays as it is, so it must be present, and a second one too
        out = F.when(n - F.when(F.min_by(v, order).isNotNull(), 1).otherwise(0) > 0, 2 * F.min_by(v, order) - F.sum(v))
    elif name in ("count", "sum", "total", "max", "min", "last", "current", "range", "rangeOf", "median", "multiply", "stddev"):
        out = fold(name, v, order)
    elif name == "first":
        out = F.when(n > 0, F.min_by(v, order))
    elif m := _PERCENT.match(name):
        out = percentile(v, float(m.group(1)))
    else:
        out = F.max(F.lit(None).cast("double"))
    if xff is not None:
        out = F.when(n / rows(v) >= (F.lit(xff) if isinstance(xff, (int, float)) else F.max(xff)), out)
    return out


def known_summary(name: str) -> str:
    if name not in SUMMARIES and not _PERCENT.match(name):
        raise EvalError(f"unsupported aggregate {name}")
    return name


CONSOLIDATIONS = ("sum", "total", "max", "maximum", "min", "minimum", "first", "last", "current", "median", "count", "multiply", "range", "diff", "stddev", "avg_zero")


def consolidate(v: Column, order: Column, how: Column, used: Collection[str] = CONSOLIDATIONS) -> Column:
    """Each series by its own consolidation function, named in a column; names it does not know mean the average.

    Every function costs each group, so `used` says which of them occur.
    """
    names = [f for f in CONSOLIDATIONS if f in used]
    out, place = F.when(F.lit(False), F.lit(None).cast("double")), F.lit(-1)
    for i, f in enumerate(names):
        place = F.when(how == f, i).otherwise(place)
    by = F.max(place)  # of numbers, as text would make the aggregate sort
    for i, f in enumerate(names):
        out = out.when(by == i, fold(f, v, order))
    return out.otherwise(F.avg(v))
