"""The driver's tables as series."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from .base import TableSource
from .responses import ResponsesSource


def epoch(df: DataFrame, c: str) -> Column:
    """A time column as epoch seconds; times without a zone are UTC."""
    if df.schema[c].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', `{c}`)")
    return F.unix_timestamp(c)


def moment(df: DataFrame, c: str, ts: int) -> Column:
    """Epoch seconds as a literal of a time column's type, so that a comparison reaches the scan."""
    if df.schema[c].dataType.typeName() == "timestamp_ntz":
        text = datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_seconds(F.lit(ts))


def events(spark: SparkSession, d: str, parts: int = 3, step: int = 3600, how: str = "sum") -> TableSource:
    """`shop.<type>.g<user mod parts>;type=..;grp=..`, hourly sums of `value`."""
    df = read(spark, d, "events")
    g = F.concat(F.lit("g"), (F.col("user_id") % parts).cast("string"))
    name = F.concat(F.lit("shop."), "event_type", F.lit("."), g, F.lit(";grp="), g, F.lit(";type="), "event_type")
    return TableSource(df, name, epoch(df, "ts"), F.col("value"), step, how, "ts")


def shipments(spark: SparkSession, d: str) -> TableSource:
    """`ship.<flag>.<status>.l<line>`, daily sums of quantity."""
    df = read(spark, d, "lineitem")
    name = F.concat(F.lit("ship."), "l_returnflag", F.lit("."), "l_linestatus", F.lit(".l"), F.col("l_linenumber").cast("string"))
    return TableSource(df, name, epoch(df, "l_shipdate"), F.col("l_quantity"), 86400, "sum", "l_shipdate")


def orders(spark: SparkSession, d: str) -> TableSource:
    """`orders.<priority>.total`, daily sums of the price."""
    df = read(spark, d, "orders")
    name = F.concat(F.lit("orders."), F.regexp_replace("o_orderpriority", r"\W+", "_"), F.lit(".total"))
    return TableSource(df, name, epoch(df, "o_orderdate"), F.col("o_totalprice"), 86400, "sum", "o_orderdate")


def fetched(spark: SparkSession, d: str) -> ResponsesSource:
    """The stored fetch responses under their catalogue."""
    return ResponsesSource(read(spark, d, "fetch_responses"), read(spark, d, "series"))


def served(spark: SparkSession, d: str) -> ResponsesSource:
    """The answers of several servers under the same catalogue."""
    return ResponsesSource(read(spark, d, "server_responses"), read(spark, d, "series"))
