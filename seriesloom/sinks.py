"""Results as DataFrames of text, one row per series, and as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import align
from .model import SeriesFrame

UNITS = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}


def _number(v: Column) -> Column:
    """A value as JSON has it: whole numbers without a point, nothing for absent or infinite ones."""
    whole = (F.abs(v) < 1e15) & (v == F.floor(v))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("string")).when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def to_json(frame: SeriesFrame, max_data_points: int = 0, no_null_points: bool = False, unit: str = "s") -> DataFrame:
    """`ord, json`: {"target":..., "datapoints":[[value, time]...], "tags":{...}} per series."""
    f = align.max_points(frame, max_data_points) if max_data_points else frame
    points = f.points.where(F.col("v").isNotNull()) if no_null_points else f.points
    pair = F.concat(F.lit("["), F.coalesce(_number(F.col("v")), F.lit("null")), F.lit(","), (F.col("ts") * UNITS[unit]).cast("string"), F.lit("]"))
    lists = points.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ts", pair.alias("p")))).alias("ps"))
    joined = f.series.join(lists, "sid", "left")
    body = F.array_join(F.transform(F.coalesce("ps", F.array().cast("array<struct<ts:bigint,p:string>>")), lambda x: x["p"]), ",")
    target = F.to_json(F.struct(F.col("name").alias("target")))
    head = F.expr("substring(__t, 1, length(__t) - 1)")
    return joined.withColumn("__t", target).select("ord", F.concat(head, F.lit(',"datapoints":['), body, F.lit('],"tags":'), F.to_json("tags"), F.lit("}")).alias("json"))


def to_csv(frame: SeriesFrame) -> DataFrame:
    """`ord, ts, line`: "name",YYYY-MM-DD HH:MM:SS,value per point; nothing after the last comma where absent."""
    rows = frame.result()
    when = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss")
    return rows.select("ord", "ts", F.concat(F.lit('"'), "name", F.lit('",'), when, F.lit(","), F.coalesce(_number(F.col("value")), F.lit(""))).alias("line"))


def to_raw(frame: SeriesFrame) -> DataFrame:
    """`ord, line`: name,start,stop,step|value,value,None per series."""
    shown = F.coalesce(_number(F.col("v")), F.lit("None"))
    lists = frame.points.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ts", shown.alias("p")))).alias("ps"))
    joined = frame.series.join(lists, "sid", "left")
    body = F.array_join(F.transform(F.coalesce("ps", F.array().cast("array<struct<ts:bigint,p:string>>")), lambda x: x["p"]), ",")
    head = F.concat_ws(",", "name", F.col("start").cast("string"), F.col("stop").cast("string"), F.col("step").cast("string"))
    return joined.select("ord", F.concat(head, F.lit("|"), body).alias("line"))


def write_parquet(frame: SeriesFrame, path: str) -> None:
    """The list as rows `ord, name, ts, value`, in files by series."""
    frame.result().repartition("name").sortWithinPartitions("name", "ts").write.mode("overwrite").parquet(path)
