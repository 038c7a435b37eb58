"""Shared steps over fetch responses: one spelling per series, values placed in time.

All of it is built-in expressions, so it stays in the scan's code-generated
stage and needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400


#: What a name in regular spelling has not; names with several tags must have them in order besides.
_IRREGULAR = r"\s|^[.;]|\.\.|\.;|;;|[.;]$|^$|=[^;]*="


def canonical_name(name: Column | str) -> Column:
    """The regular spelling of a series name.

    White space at the ends goes, empty path nodes (surplus dots) go, tags are
    put in the order of their keys; empty tags go, of equal tags one stays.
    Null stays null. The case of letters is kept: it is part of a name. Most names
    are regular already, which is cheaper to see than to bring about.
    """
    c = F.col(name) if isinstance(name, str) else name
    # with \x01 for = the order of tags is that of their keys
    rest = F.split(F.translate(c, "=", "\x01"), ";")
    tags = F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))
    regular = ~c.rlike(_IRREGULAR) & ((F.size(rest) <= 2) | ((F.sort_array(tags) == tags) & (F.size(F.array_distinct(tags)) == F.size(tags))))
    return F.when(regular, c).otherwise(_respelled(c))


def _respelled(c: Column) -> Column:
    parts = F.split(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), ";")
    nodes = F.filter(F.split(F.trim(parts[0]), r"\."), lambda x: F.trim(x) != "")
    path = F.array_join(F.transform(nodes, lambda x: F.trim(x)), ".")
    tags = F.filter(
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(x)),
        lambda x: x != "",
    )
    keyed = F.sort_array(
        F.array_distinct(F.transform(tags, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), x.alias("t"))))
    )
    joined = F.array_join(F.transform(keyed, lambda x: x["t"]), ";")
    return F.when(F.size(keyed) > 0, F.concat(path, F.lit(";"), joined)).otherwise(path)


def present(v: Column) -> Column:
    """Neither null nor NaN; absent values are either."""
    return v.isNotNull() & ~F.isnan(v)


def place(df: DataFrame, keep: list[str], vals: str = "vals") -> DataFrame:
    """One row per present value that counts: the columns `keep`, `ts` and `v`.

    vals[i] belongs to start + i*step; what falls at or after `stop` does not
    count. Rows with a null or non-positive step, or a null start, vals or stop,
    give nothing.
    """
    usable = (F.col("step") > 0) & F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.size(vals) > 0)
    return (
        df.where(usable)
        .select(*keep, F.col("start").alias("__start"), F.col("stop").alias("__stop"), F.col("step").alias("__step"), F.posexplode(vals).alias("__i", "v"))
        .where(present(F.col("v")))
        .withColumn("ts", F.col("__start") + F.col("__i") * F.col("__step"))
        .where(F.col("ts") < F.col("__stop"))
        .drop("__start", "__stop", "__step", "__i")
    )


def by_day_parts(df: DataFrame, keep: list[str], vals: str = "vals", by_time: bool = False) -> DataFrame:
    """Each response once per UTC day it has values for: `keep, step, day, slot0, part`.

    `part` are the values of that day before the response's stop, the first of
    them in slot `slot0` (times are slot * step; times off the step belong to the
    slot they lie in). A value is of the day of its slot, or, `by_time`, of the day
    of its own time. Values stay in arrays, so an exchange moves eight bytes a
    value. Rows that place() leaves out are left out here.
    """
    usable = (F.col("step") > 0) & F.col("start").isNotNull() & F.col("stop").isNotNull() & (F.size(vals) > 0)
    n = F.least(F.size(vals).cast("long"), F.ceil(F.try_divide(F.col("stop") - F.col("start"), F.col("step"))))
    rows = df.where(usable).withColumn("n", n.cast("long")).where("n > 0").withColumn("s0", F.floor(F.col("start") / F.col("step")).cast("long"))
    # the time of the first value: its own, or that of its slot
    t0 = F.col("start") if by_time else F.col("s0") * F.col("step")
    rows = rows.withColumn("t0", t0)
    first = F.floor(F.col("t0") / DAY)
    last = F.floor((F.col("t0") + (F.col("n") - 1) * F.col("step")) / DAY)
    days = rows.select(*keep, "step", "s0", "t0", "n", vals, F.explode(F.sequence(first, last)).alias("day"))
    upto = lambda day: F.ceil((day * DAY - F.col("t0")) / F.col("step")).cast("long")
    i0 = F.greatest(upto(F.col("day")), F.lit(0))
    i1 = F.least(upto(F.col("day") + 1), F.col("n"))
    cut = F.slice(vals, (F.col("i0") + 1).cast("int"), (F.col("i1") - F.col("i0")).cast("int"))
    return (
        days.withColumn("i0", i0).withColumn("i1", i1).where("i1 > i0")
        .select(*keep, "step", F.col("day").cast("int").alias("day"), (F.col("s0") + F.col("i0")).alias("slot0"), cut.alias("part"))
    )


def series_ids(series: DataFrame) -> DataFrame:
    """`__name` (regular spelling) and `sid` of the catalogue; one sid per spelling, the smallest."""
    return series.where(F.col("name").isNotNull() & F.col("sid").isNotNull()).groupBy(canonical_name("name").alias("__name")).agg(F.min("sid").alias("sid"))
