"""A list of series as two DataFrames.

series: sid long, ord int, name string, path_expr string, tags map, start, stop,
        step long, cons_func string, xff double, opts map<string,string>
points: sid long, ts long, v double -- one row per grid slot in [start, stop);
        an absent value is NULL, never NaN.

Functions on names touch only `series`, functions on values only `points`, and
both stay lazy. `step` is known on the driver where all series share one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("sid", "ord", "name", "path_expr", "tags", "start", "stop", "step", "cons_func", "xff", "opts")
SERIES_DDL = (
    "sid long, ord int, name string, path_expr string, tags map<string,string>, start long, stop long, "
    "step long, cons_func string, xff double, opts map<string,string>"
)
POINTS_DDL = "sid long, ts long, v double"


@dataclass(frozen=True)
class SeriesFrame:
    series: DataFrame
    points: DataFrame
    step: int | None = None

    def with_points(self, points: DataFrame) -> "SeriesFrame":
        return replace(self, points=points)

    def with_series(self, series: DataFrame) -> "SeriesFrame":
        return replace(self, series=series)

    def map(self, v: Column) -> "SeriesFrame":
        """Each value by an expression over `ts` and `v`; NaN becomes absent."""
        return self.with_points(self.points.select("sid", "ts", absent_nan(v).alias("v")))

    def rename(self, name: Column) -> "SeriesFrame":
        return self.with_series(self.series.withColumn("name", name))

    def call(self, fn: str, *rest: str) -> "SeriesFrame":
        """Names as the results of a call: fn(name,rest...)."""
        tail = "".join("," + r for r in rest) + ")"
        return self.rename(F.concat(F.lit(fn + "("), F.col("name"), F.lit(tail)))

    def tag(self, key: str, value: str) -> "SeriesFrame":
        return self.with_series(self.series.withColumn("tags", put_tag(F.col("tags"), key, F.lit(value))))

    def joined(self, *cols: str) -> DataFrame:
        """Points with columns of their series."""
        return self.points.join(self.series.select("sid", *cols), "sid")

    def keep(self, sids: DataFrame) -> "SeriesFrame":
        """Only the series whose sid is listed."""
        return replace(self, series=self.series.join(sids.select("sid"), "sid", "left_semi"), points=self.points.join(sids.select("sid"), "sid", "left_semi"))

    def common_step(self) -> int:
        """The largest step; asks the series (a small table) only where it is not known."""
        if self.step is not None:
            return self.step
        got = self.series.agg(F.max("step")).first()[0]
        return int(got) if got else 1

    def result(self) -> DataFrame:
        """`ord, name, ts, value`: the list as rows."""
        return self.points.join(self.series.select("sid", "ord", "name"), "sid").select("ord", "name", "ts", F.col("v").alias("value"))


def V() -> Column:  # noqa: N802 - columns exist only within a session
    """The value."""
    return F.col("v")


def TS() -> Column:  # noqa: N802
    """The time."""
    return F.col("ts")


def NAME() -> Column:  # noqa: N802
    """The series' name."""
    return F.col("name")


def NULL() -> Column:  # noqa: N802
    """Absent."""
    return F.lit(None).cast("double")


def absent_nan(v: Column) -> Column:
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


def put_tag(tags: Column, key: str, value: Column) -> Column:
    kept = F.map_filter(F.coalesce(tags, empty_map()), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value))


def empty_map() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def by_series() -> Window:
    return Window.partitionBy("sid").orderBy("ts")


def past(n: int | None = None) -> Window:
    """The rows of a series up to this one; the last n of them where n is given."""
    return by_series().rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0)


def tags_of(name: Column) -> Column:
    """The tags in a name `path;k=v;...`, with the path as tag `name`."""
    parts = F.split(name, ";")
    pairs = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.split(x, "=", 2)), lambda x: F.size(x) == 2)
    pairs = F.concat(F.array(F.array(F.lit("name"), parts[0])), F.filter(pairs, lambda x: x[0] != "name"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(x[0].alias("key"), x[1].alias("value"))))


def inner_metric(name: Column) -> Column:
    """The metric inside a name such as f(g(a.b.c,1)): what follows the last bracket before the first comma or bracket end, without tags."""
    inside = F.regexp_extract(name, r"^(?:[^(),;{}]*\()*((?:[^,(){};]|\{[^}]*\})*)", 1)
    return F.when(inside == "", name).otherwise(inside)


def nodes_of(name: Column) -> Column:
    return F.split(inner_metric(name), r"\.")


def node_key(nodes: list[int | str]) -> Column:
    """The listed path nodes (negative ones from the end; missing ones left out) and tag values, joined by dots."""
    parts = []
    for n in nodes:
        if isinstance(n, str):
            parts.append(F.coalesce(F.try_element_at("tags", F.lit(n)), F.lit("")))
        else:
            parts.append(F.try_element_at(nodes_of(F.col("name")), F.lit(n + 1 if n >= 0 else n)))
    return F.concat_ws(".", *parts)


def natural_key(name: Column) -> Column:
    """A name with its runs of digits padded, so that plain order is natural order."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x)), "")


def renumber(series: DataFrame, *order: Column) -> DataFrame:
    """New positions in the list. One sort over series, not points."""
    return series.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("int"))


def frame_of(spark, rows: list[dict], step: int | None = None) -> SeriesFrame:
    """A frame in memory: rows with name, start, step, values and what else a series has."""
    series, points = [], []
    for i, r in enumerate(rows):
        n = len(r["values"])
        sid = r.get("sid", i + 1)
        tags = {"name": r["name"].split(";")[0]} | dict(x.split("=", 1) for x in r["name"].split(";")[1:])
        series.append((sid, i + 1, r["name"], r.get("path_expr", r["name"]), tags, r["start"], r["start"] + n * r["step"], r["step"], r.get("cons_func", "average"), float(r.get("xff", 0.0)), {}))
        points += [(sid, r["start"] + k * r["step"], None if v is None or v != v else float(v)) for k, v in enumerate(r["values"])]
    steps = {r["step"] for r in rows}
    return SeriesFrame(spark.createDataFrame(series, SERIES_DDL), spark.createDataFrame(points, POINTS_DDL), steps.pop() if len(steps) == 1 else step)
