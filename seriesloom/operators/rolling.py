"""Totals over trailing periods by a two-stack queue (problem 1).

The plan, in stages:

1. The catalogue gives each response its sid, and the response is cut by day, its
   values staying in arrays, so that an exchange moves eight bytes a value.
2. One exchange on (sid, day). A series that holds a third of all rows is spread
   over its days; days delivered again drop out, slots are made distinct and the
   day's totals built inside that same partitioning, with no further exchange.
3. Days are small next to values. They meet the calendar (each day of each
   series) in one exchange on (sid, block of days), each block with the longest
   period before it as a lead-in, so that no task needs a whole entity.
4. Sorted partitions stream through a two-stack queue per entity, which needs
   only an associative combine: totals, counts, minima and maxima alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .responses import DAY, by_day_parts, canonical_name, present, series_ids


class TwoStackQueue:
    """A first-in first-out window with its aggregate at hand, for any associative combine.

    Elements enter the back stack, which keeps one running aggregate. When the
    front stack runs empty the back is turned over, and each front entry keeps
    the aggregate from itself to the end of the front. Each element is combined
    twice at most, and nothing is ever subtracted, so the combine needs no
    inverse (minima, maxima, sketches).
    """

    __slots__ = ("combine", "front", "back", "back_total", "keys_front", "keys_back")

    def __init__(self, combine: Callable[[Any, Any], Any]):
        self.combine = combine
        self.front: list[Any] = []
        self.keys_front: list[int] = []
        self.back: list[Any] = []
        self.keys_back: list[int] = []
        self.back_total: Any = None

    def push(self, key: int, x: Any) -> None:
        self.back.append(x)
        self.keys_back.append(key)
        self.back_total = x if self.back_total is None else self.combine(self.back_total, x)

    def evict_before(self, key: int) -> None:
        """Drop the elements whose key is smaller."""
        while True:
            if not self.front:
                if not self.keys_back or self.keys_back[0] >= key:
                    return
                total = None
                while self.back:
                    x = self.back.pop()
                    total = x if total is None else self.combine(x, total)
                    self.front.append(total)
                    self.keys_front.append(self.keys_back.pop())
                self.back_total = None
            if self.keys_front[-1] >= key:
                return
            self.front.pop()
            self.keys_front.pop()

    def total(self) -> Any:
        """The aggregate of the window, None if it is empty."""
        if not self.front:
            return self.back_total
        if self.back_total is None:
            return self.front[-1]
        return self.combine(self.front[-1], self.back_total)


def _combine(a: tuple, b: tuple) -> tuple:
    return (a[0] + b[0], a[1] + b[1], a[2] if a[2] <= b[2] else b[2], a[3] if a[3] >= b[3] else b[3])


def daily_activity(responses: DataFrame, series: DataFrame) -> DataFrame:
    """`sid, day, total, n, low, high` of each day with a present value.

    `day` counts days since 1970. A slot is the value's time taken down to the
    step; however often it was delivered it counts once. Deliveries of a slot
    agree in these data; where they do not, the largest value is taken, so that
    the result depends on no order.
    """
    rows = responses.select(canonical_name("name").alias("__name"), "start", "stop", "step", "vals").where(F.col("__name").isNotNull())
    known = rows.join(series_ids(series), "__name").drop("__name")
    # a day delivered again as it was drops out within the exchange's own tasks
    parts = by_day_parts(known, ["sid"]).repartition("sid", "day").dropDuplicates(["sid", "day", "step", "slot0", "part"])
    values = parts.select("sid", "day", "step", "slot0", F.posexplode("part").alias("i", "v")).where(present(F.col("v")))
    slots = values.groupBy("sid", "day", ((F.col("slot0") + F.col("i")) * F.col("step")).alias("slot")).agg(F.max("v").alias("v"))
    return slots.groupBy("sid", "day").agg(
        F.sum("v").alias("total"), F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def calendar(series: DataFrame) -> DataFrame:
    """`sid, day`: each UTC day at or after a series' start and before its stop.

    A series with a null start or stop, or one that ends before it starts, has no day.
    """
    first = F.floor(F.col("start") / F.lit(DAY)).cast("int")
    last = F.ceil(F.col("stop") / F.lit(DAY)).cast("int") - 1
    return (
        series.where(F.col("sid").isNotNull())
        .groupBy("sid")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .where(last >= first)
        .select("sid", F.explode(F.sequence(first, last)).alias("day"))
    )


def rolling_totals(
    responses: DataFrame,
    series: DataFrame,
    periods: Sequence[int] = (7, 30),
    block_days: int = 2048,
) -> DataFrame:
    """For each series and day the totals and averages over the trailing periods.

    Columns `sid long, day date, active boolean, n_day long`, and for each period p
    `total_p, avg_p, min_p, max_p double, n_p long`. A period of p days ends with
    the day itself. Days without activity have
    a row; a total over no value is 0.0, an average, minimum or maximum over none
    is null. Values outside a series' own days count in the periods that reach
    them, but give no row.

    Null names, names that are not in the catalogue, null, empty or short `vals`
    give no activity; an empty catalogue gives an empty result. Extra columns of
    either table are ignored. Infinite values count as present.
    """
    periods = sorted({int(p) for p in periods})
    if not periods or periods[0] < 1:
        raise ValueError("periods must be positive numbers of days")
    queued = sorted({1, *periods})  # the day itself is a period too: it says whether there was activity
    longest = periods[-1]
    if block_days < longest:
        raise ValueError("block_days must reach the longest period")
    days = calendar(series).select("sid", "day", F.lit(True).alias("shown"), F.lit(None).cast("double").alias("total"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    seen = daily_activity(responses, series).select("sid", "day", F.lit(False).alias("shown"), "total", "n", "low", "high")
    events = days.unionByName(seen)
    # A day belongs to its own block and, within a period's length before the next one, also leads into that.
    block = F.floor(F.col("day") / F.lit(block_days)).cast("int")
    ahead = F.floor((F.col("day") + F.lit(longest - 1)) / F.lit(block_days)).cast("int")
    blocks = F.when(ahead > block, F.array(block, ahead)).otherwise(F.array(block))
    events = events.select("*", F.explode(blocks).alias("block")).repartition("sid", "block").sortWithinPartitions("sid", "block", "day", "shown")

    out = [T.StructField("sid", T.LongType()), T.StructField("day", T.IntegerType()), T.StructField("n_day", T.LongType())]
    for p in periods:
        out += [T.StructField(f"{k}_{p}", T.DoubleType()) for k in ("total", "avg", "min", "max")] + [T.StructField(f"n_{p}", T.LongType())]
    names = [f.name for f in out]

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        queues: list[TwoStackQueue] = []
        for pdf in batches:
            rows = []
            for sid, day, shown, total, n, low, high, blk in zip(*(pdf[c].tolist() for c in ("sid", "day", "shown", "total", "n", "low", "high", "block"))):
                if at != (sid, blk):
                    at = (sid, blk)
                    queues = [TwoStackQueue(_combine) for _ in queued]
                if not shown:
                    for q in queues:
                        q.push(day, (total, n, low, high))
                    continue
                if day // block_days != blk:  # a lead-in day is shown by its own block
                    continue
                row: list = [sid, day, 0]
                for p, q in zip(queued, queues):
                    q.evict_before(day - p + 1)
                    t = q.total()
                    if p == 1 and t is not None:
                        row[2] = t[1]
                    if p not in periods:
                        continue
                    row += [0.0, None, None, None, 0] if t is None else [t[0], t[0] / t[1], t[2], t[3], t[1]]
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    ship(events.sparkSession)
    ran = events.mapInPandas(slide, T.StructType(out))
    return ran.select(
        "sid", F.date_from_unix_date("day").alias("day"), (F.col("n_day") > 0).alias("active"), "n_day", *names[3:]
    )


def inactive_days(totals: DataFrame) -> DataFrame:
    """`sid long, day string`: the days of rolling_totals() without a present value."""
    return totals.where(~F.col("active")).select("sid", F.date_format("day", "yyyy-MM-dd").alias("day"))
