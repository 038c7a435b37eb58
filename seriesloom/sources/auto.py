"""A source for a table by the columns it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.responses import canonical_name
from .base import SeriesSource, TableSource
from .responses import ResponsesSource

RESPONSES = {"name", "start", "stop", "step", "vals"}
TIMES, VALUES = ("ts", "time", "timestamp", "epoch"), ("v", "value", "val")


def catalogue_of(responses: DataFrame) -> DataFrame:
    """`name, step, cons_func, xff, start, stop`: the series that stored responses are answers for.

    A series lives from its first start to its last stop at its finest step; of
    differing consolidation functions the first by name holds, of factors the
    largest. Rows without a name, a positive step or a range are no answers.
    """
    c = set(responses.columns)
    usable = responses.where((F.col("step") > 0) & (F.col("stop") > F.col("start")) & F.col("name").isNotNull())
    cons = F.min("cons_func") if "cons_func" in c else F.lit(None).cast("string")
    xff = F.max(F.nanvl(F.col("xff").cast("double"), F.lit(None))) if "xff" in c else F.lit(None).cast("double")
    return usable.groupBy(canonical_name("name").alias("name")).agg(
        F.min("step").alias("step"), cons.alias("cons_func"), xff.alias("xff"), F.min("start").alias("start"), F.max("stop").alias("stop")
    )


def open_source(df: DataFrame, step: int = 60, catalogue: DataFrame | None = None, how: str = "avg") -> SeriesSource:
    """Stored responses (name, start, stop, step, vals), with or without a catalogue, or rows of a name, a time and a value.

    Of rows a time may be a timestamp or epoch seconds, and values of one slot of
    `step` seconds are aggregated by `how`. Other tables are a ValueError.
    """
    if RESPONSES <= set(df.columns):
        return ResponsesSource(df, catalogue if catalogue is not None else catalogue_of(df))
    ts, v = next((c for c in TIMES if c in df.columns), None), next((c for c in VALUES if c in df.columns), None)
    if "name" not in df.columns or ts is None or v is None:
        raise ValueError(f"no series in the columns {', '.join(df.columns)}")
    timed = df.schema[ts].dataType.typeName().startswith("timestamp")
    from .tables import epoch

    return TableSource(df, F.col("name"), epoch(df, ts) if timed else F.col(ts).cast("long"), F.col(v), step, how, ts if timed else None)
