"""Percentiles of very large numeric columns by dyadic Count-sketches (problem 5).

A value becomes a code that keeps the order of numbers: its sign and its place on
a logarithmic scale of relative width `2 * alpha`, over the whole range of doubles.
Level l of the codes counts their first l bits, so its cells are half as wide as
those of the level before. A sketch holds, for each level,

* the cells and their counts as a list, exactly, while there are no more of them
  than a sketch has columns. Only the finest such level is stored, as it implies
  the coarser ones; a group whose codes all fit is nothing but that list;
* beyond that a signed Count-sketch of `depth` rows and `width` columns.

Sketches are merged by addition, so values can also be taken away again, and a
rank is inverted by descending the levels.

Error. The value found is within the factor (1 + alpha) of one whose rank is off
by the sketched levels' error, nothing for a list. A row's estimate of a cell has a
variance of F2 / width, F2 being the sum of squares of the counts of that level
without the heaviest width/64 columns: to be moved by one of those a cell must
meet them in most rows, which has a chance below delta. The median of the rows is
taken. `sized(epsilon, delta)` gives the width and depth for which the error
stays within epsilon of all values but for a chance of delta, whatever the values;
`rank_error` states it for each group from its own counters.

The plan: values stay in arrays until the workers of the scan, which add up
sketches per (group, day) over many rows and send them packed; parts of one group
and day are merged in two steps (bounded parts, then all), so are the days of a
group. Nothing larger than a sketch is ever sent.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.responses import by_day_parts, canonical_name
from ..session import ship, written

#: Codes that a worker holds before it sends what it has added up.
HELD = 4_000_000


@dataclass(frozen=True)
class Codes:
    """An order-preserving code of doubles with a bounded relative error, from the smallest normal double to the largest.

    What is smaller in size than `smallest` counts as zero; infinities are the ends.
    """

    alpha: float = 0.0001
    smallest: float = 2.2250738585072014e-308
    largest: float = 1.7976931348623157e308

    @property
    def ratio(self) -> float:
        return float(np.log((1 + self.alpha) / (1 - self.alpha)))

    @property
    def half(self) -> int:
        return int(np.ceil((np.log(self.largest) - np.log(self.smallest)) / self.ratio)) + 2

    @property
    def bits(self) -> int:
        return int(np.ceil(np.log2(2 * self.half + 1)))

    def encode(self, v: np.ndarray) -> np.ndarray:
        size = np.abs(v)
        place = np.floor((np.log(np.clip(size, self.smallest, self.largest)) - np.log(self.smallest)) / self.ratio).astype(np.int64) + 1
        place = np.where(np.isinf(v), self.half, place)
        return np.where(size < self.smallest, self.half, np.where(v > 0, self.half + place, self.half - place))

    def decode(self, code: np.ndarray | int) -> np.ndarray:
        """A value within `alpha` of every value with this code."""
        p = np.asarray(code, dtype=float) - self.half
        with np.errstate(over="ignore"):
            mid = np.exp(np.log(self.smallest) + (np.abs(p) - 1) * self.ratio + np.log(2 / (1 + np.exp(-self.ratio))))
        return np.where(p == 0, 0.0, np.where(np.abs(p) == self.half, np.copysign(np.inf, p), np.sign(p) * np.minimum(mid, self.largest)))


def sized(epsilon: float, delta: float, bits: int) -> tuple[int, int]:
    """Width (a power of two) and depth of sketches whose rank error is within epsilon but for a chance of delta.

    At worst the counts beside the w/64 heaviest have F2 = 16/w of the square of
    all, and no level but the exact ones, log2(w) at least, is without error.
    """
    if not (0 < epsilon < 1 and 0 < delta < 1):
        raise ValueError("epsilon and delta are between 0 and 1")
    depth = max(3, 2 * math.ceil(math.log10(1 / delta)) + 1)
    z, width = NormalDist().inv_cdf(1 - delta / 2), 64
    while z * math.sqrt(1.5708 / depth * max(bits - math.log2(width), 0) * 16 / width**2) > epsilon:
        width *= 2
    return width, depth


@dataclass
class Sketch:
    """The cells of level `level` with their counts, and the Count-sketches of the finer levels (level by depth by width)."""

    level: int
    cells: np.ndarray
    counts: np.ndarray
    rows: np.ndarray

    @property
    def n(self) -> int:
        return int(self.counts.sum())


def _grouped(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell once, in order, with its counts added up; those of 0 go."""
    if not len(cells):
        return cells.astype(np.int64), counts.astype(np.int64)
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
    counts = np.add.reduceat(counts, first)
    some = counts != 0
    return cells[first][some].astype(np.int64), counts[some].astype(np.int64)


class DyadicSketch:
    """The shape that all sketches to be merged have in common."""

    def __init__(self, bits: int, width: int, depth: int, delta: float = 0.01, seed: int = 11):
        if width & (width - 1):
            raise ValueError("width must be a power of two")
        self.bits, self.width, self.depth, self.z = bits, width, depth, NormalDist().inv_cdf(1 - delta / 2)
        rng = np.random.default_rng(seed)
        # multiply-shift hashing, the same for every sketch of these parameters
        self.mult = rng.integers(1, 2**63, size=(bits + 1, depth, 2), dtype=np.uint64) | np.uint64(1)

    def place(self, level: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column and sign of cells in each row of a level: two arrays of (depth, cells)."""
        x = cell.astype(np.uint64)[None, :] + np.uint64(1)
        h = x * self.mult[level, :, 0][:, None]
        h ^= h >> np.uint64(29)
        h = h * self.mult[level, :, 1][:, None]
        col = (h >> np.uint64(64 - int(np.log2(self.width)))).astype(np.int64)
        sign = 1 - 2 * ((h >> np.uint64(20)) & np.uint64(1)).astype(np.int64)
        return col, sign

    def _coarsened(self, level: int, cells: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> Sketch:
        """The list taken up to the finest level at which it is short enough; the levels left behind become Count-sketches."""
        left = []
        while len(cells) > self.width:
            col, sign = self.place(level, cells)
            made = np.zeros((self.depth, self.width), np.int64)
            for r in range(self.depth):
                np.add.at(made[r], col[r], sign[r] * counts)
            left.append(made)
            level -= 1
            cells, counts = _grouped(cells >> 1, counts)
        return Sketch(level, cells, counts, np.concatenate([np.array(left[::-1], np.int64).reshape(-1, self.depth, self.width), rows]))

    def build(self, codes: np.ndarray, counts: np.ndarray | None = None) -> Sketch:
        """The sketch of codes with counts (1 where none are given); a negative count takes values away."""
        counts = np.ones(len(codes), np.int64) if counts is None else counts
        return self._coarsened(self.bits, *_grouped(np.asarray(codes, np.int64), np.asarray(counts, np.int64)), np.zeros((0, self.depth, self.width), np.int64))

    def add(self, a: Sketch, b: Sketch) -> Sketch:
        if a.level > b.level:
            a, b = b, a
        # b has its list at a finer level: its levels down to a's become Count-sketches too
        cells, counts, rows = b.cells, b.counts, b.rows
        for level in range(b.level, a.level, -1):
            col, sign = self.place(level, cells)
            made = np.zeros((1, self.depth, self.width), np.int64)
            for r in range(self.depth):
                np.add.at(made[0, r], col[r], sign[r] * counts)
            rows = np.concatenate([made, rows])
            cells, counts = _grouped(cells >> 1, counts)
        return self._coarsened(a.level, *_grouped(np.append(a.cells, cells), np.append(a.counts, counts)), a.rows + rows)

    def estimate(self, s: Sketch, level: int, cell: int) -> float:
        col, sign = self.place(level, np.array([cell]))
        return float(np.median(sign[:, 0] * s.rows[level - s.level - 1][np.arange(self.depth), col[:, 0]]))

    def code_at(self, s: Sketch, q: float) -> int:
        """The code that holds the value of rank ceil(q * n): a cell of the list, then down the sketched levels."""
        run = np.cumsum(s.counts)
        need = max(1.0, np.ceil(q * run[-1]))
        i = int(np.searchsorted(run, need))
        cell, mass = int(s.cells[i]), float(s.counts[i])
        need -= run[i] - s.counts[i]
        for level in range(s.level + 1, self.bits + 1):
            left, right = (min(max(self.estimate(s, level, 2 * cell + k), 0.0), mass) for k in (0, 1))
            # the two halves make up their parent, whose mass is known better
            left = mass * left / (left + right) if left + right > 0 else mass / 2
            if need <= left + 1e-9:
                cell, mass = 2 * cell, left
            else:
                cell, need, mass = 2 * cell + 1, need - left, mass - left
        return cell

    def rank_error(self, s: Sketch) -> float:
        """What the rank is off by at most, as a share of the values, but for a chance of delta."""
        if s.n <= 0 or not len(s.rows):
            return 0.0
        squares = np.sort(s.rows.astype(float) ** 2, axis=2)[:, :, : self.width - self.width // 64].sum(axis=2)
        var = np.median(squares, axis=1).sum() / self.width * 1.5708 / self.depth
        return float(min(1.0, self.z * np.sqrt(var) / s.n))

    def pack(self, s: Sketch) -> bytes:
        head = np.array([s.level, len(s.cells)], "<i8").tobytes()
        steps = np.diff(s.cells, prepend=0).astype("<i4")
        return zlib.compress(head + steps.tobytes() + s.counts.astype("<i8").tobytes() + s.rows.astype("<i8").tobytes(), 1)

    def unpack(self, data: bytes) -> Sketch:
        raw = zlib.decompress(data)
        level, k = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        steps = np.frombuffer(raw, "<i4", k, 16)
        counts = np.frombuffer(raw[16 + 4 * k : 16 + 12 * k], "<i8")
        return Sketch(level, np.cumsum(steps.astype(np.int64)), counts, np.frombuffer(raw[16 + 12 * k :], "<i8").reshape(-1, self.depth, self.width))


def build_sketches(arrays: DataFrame, keys: Sequence[str], codes: Codes, shape: DyadicSketch, vals: str = "vals", sign: str | None = None) -> DataFrame:
    """`keys, sketch`: sketches of the present values of array columns, one or more per group, made where rows are read.

    A column `sign` of -1 takes a row's values away. Keys may be null.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {arrays.schema[k].dataType.simpleString()}" for k in keys)
    rows = arrays.select(*keys, F.col(vals).alias("__vals"), (F.col(sign).cast("long") if sign else F.lit(1).cast("long")).alias("__sign"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def sent() -> pa.RecordBatch:
            made = []
            for key, parts in held.items():
                made.append([*key, shape.pack(shape.build(np.concatenate([p[0] for p in parts]), np.concatenate([np.full(len(c), s) for c, s in parts])))])
            held.clear()
            cols = list(zip(*made)) if made else [()] * (len(keys) + 1)
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), pa.array(cols[-1], pa.binary())], names=[*keys, "sketch"])

        types: list = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            a = batch.column("__vals")
            flat = a.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.append(0, np.cumsum(pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False)))
            seen = ~np.isnan(flat)
            code = np.where(seen, codes.encode(np.where(seen, flat, 0.0)), -1)
            for i, (key, s) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("__sign").to_pylist())):
                c = code[ends[i] : ends[i + 1]]
                c = c[c >= 0]
                if len(c):
                    held.setdefault(key, []).append((c, s))
                    size += len(c)
            if size >= HELD:
                yield sent()
                size = 0
        if held:
            yield sent()

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"{kinds}, sketch binary")


def merge_sketches(sketches: DataFrame, keys: Sequence[str], shape: DyadicSketch, spread: Column | None = None) -> DataFrame:
    """`keys, n, sketch`: sketches of equal keys added up.

    `spread` names a bounded part of each group that is added up first, so that
    no task adds up all sketches of a large group.
    """
    keys = list(keys)
    if spread is not None:
        part = merge_sketches(sketches.withColumn("__part", spread), [*keys, "__part"], shape)
        return merge_sketches(part.select(*keys, "sketch"), keys, shape)
    kinds = ", ".join(f"`{k}` {sketches.schema[k].dataType.simpleString()}" for k in keys)
    rows = sketches.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        parts: list[Sketch] = []
        types: list = []

        def close() -> list:
            return [*held, total().n, shape.pack(total())]

        def total() -> Sketch:
            if len(parts) > 1:
                # lists that all fit are put together at once
                if all(p.level == shape.bits for p in parts):
                    parts[:] = [shape.build(np.concatenate([p.cells for p in parts]), np.concatenate([p.counts for p in parts]))]
                while len(parts) > 1:
                    parts[:2] = [shape.add(parts[0], parts[1])]
            return parts[0]

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            out = []
            for *key, data in zip(*(batch.column(k).to_pylist() for k in (*keys, "sketch"))):
                key = tuple(key)
                if held is not None and key != held:
                    out.append(close())
                    parts.clear()
                held = key
                parts.append(shape.unpack(data))
                if len(parts) >= 64:
                    total()
            yield made(out, types)
        if held is not None:
            yield made([close()], types)

    def made(out: list, types: list) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * (len(keys) + 2)
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), pa.array(cols[-2], pa.int64()), pa.array(cols[-1], pa.binary())], names=[*keys, "n", "sketch"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"{kinds}, n long, sketch binary")


def percentiles(sketches: DataFrame, keys: Sequence[str], codes: Codes, shape: DyadicSketch, qs: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """`keys, n, p<q>..., rank_error`: the percentiles of each sketch; null where nothing is left to count."""
    keys, qs = list(keys), list(qs)
    names = [f"p{100 * q:g}".replace(".", "_") for q in qs]
    kinds = ", ".join(f"`{k}` {sketches.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                s = shape.unpack(row[-1])
                vals = [float(codes.decode(shape.code_at(s, q))) for q in qs] if s.n > 0 else [None] * len(qs)
                out.append([*(None if k is None or k != k else k for k in row[:-1]), s.n, *vals, shape.rank_error(s)])
            yield pd.DataFrame(out, columns=[*keys, "n", *names, "rank_error"])

    ship(sketches.sparkSession)
    return sketches.select(*keys, "sketch").mapInPandas(run, f"{kinds}, n long, {', '.join(f'{n} double' for n in names)}, rank_error double")


def by_expression(responses: DataFrame, series: DataFrame) -> DataFrame:
    """`path_expr, day, part`: the values of each response by UTC day under its expression.

    A null path_expr is taken from the catalogue by the series' regular name;
    values whose series is unknown to it belong to the null path_expr.
    """
    names = series.where(F.col("name").isNotNull()).groupBy(canonical_name("name").alias("__name")).agg(F.min("path_expr").alias("__expr"))
    slim = responses.select("name", "path_expr", "start", "stop", "step", "vals")
    named = slim.where(F.col("path_expr").isNotNull()).select("path_expr", "start", "stop", "step", "vals")
    # only rows without an expression meet the catalogue
    bare = slim.where(F.col("path_expr").isNull()).withColumn("__name", canonical_name("name")).join(names, "__name", "left")
    rows = named.unionByName(bare.select(F.col("__expr").alias("path_expr"), "start", "stop", "step", "vals"))
    return by_day_parts(rows, ["path_expr"], by_time=True).select("path_expr", "day", "part")


def series_percentiles(responses: DataFrame, series: DataFrame, codes: Codes = Codes(), epsilon: float = 0.01, delta: float = 0.01) -> DataFrame:
    """`path_expr, day, n, p50, p90, p95, p99, rank_error`: per path expression and day, and overall (day null).

    All present values before a response's stop count, each as often as it is
    delivered. The value of rank ceil(q*n) is found within `codes.alpha` of its
    size and `rank_error` of the rank, which is within `epsilon`, but for a chance
    of `delta`. Sketches of days (or files) are the same whatever else was read,
    and the overall row is made by adding them up. Infinite values count; values
    smaller in size than any normal double count as 0. Empty tables give no rows.
    """
    shape = DyadicSketch(codes.bits, *sized(epsilon, delta, codes.bits), delta)
    parts = build_sketches(by_expression(responses, series), ["path_expr", "day"], codes, shape, "part")
    days = written(merge_sketches(parts, ["path_expr", "day"], shape, F.pmod(F.xxhash64("sketch"), F.lit(8))))
    overall = merge_sketches(days, ["path_expr"], shape, F.floor(F.col("day") / 32).cast("int"))
    both = days.select("path_expr", F.date_from_unix_date("day").alias("day"), "sketch").unionByName(
        overall.select("path_expr", F.lit(None).cast("date").alias("day"), "sketch")
    )
    return percentiles(both, ["path_expr", "day"], codes, shape)
