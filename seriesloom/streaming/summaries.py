"""Buckets over a stream of readings: an extension for sources that do not stand still."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIMPLE = {"sum": F.sum, "total": F.sum, "avg": F.avg, "average": F.avg, "max": F.max, "min": F.min, "count": F.count}


def _value(how: str, v: str) -> Column:
    if how in ("range", "rangeOf"):
        return F.max(v) - F.min(v)
    if how == "stddev":
        return F.stddev_pop(v)
    if how not in _SIMPLE:
        raise ValueError(f"unsupported aggregate {how}")
    return _SIMPLE[how](v).cast("double")


def summarize_stream(stream: DataFrame, interval: str, how: str = "sum", name: str = "name", time: str = "ts", v: str = "v", late: str | None = "10 minutes", slide: str | None = None) -> DataFrame:
    """`name, ts, value` per bucket of a stream (or a static table), tumbling or sliding.

    Values may come `late` by as much; what is later is left out, and state older
    than that is dropped. None keeps the lateness that the stream has already, as
    after distinct_readings().
    """
    window = F.window(time, interval, slide) if slide else F.window(time, interval)
    rows = (stream.withWatermark(time, late) if late else stream).where(F.col(v).isNotNull() & ~F.isnan(v))
    return rows.groupBy(name, window.alias("w")).agg(_value(how, v).alias("value")).select(F.col(name).alias("name"), F.unix_timestamp("w.start").alias("ts"), "value")


def distinct_readings(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The stream without readings that were delivered again within the lateness."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
