"""Implausible values in measurements (problem 3).

What decides, per series:

* Spikes: detail coefficients of an undecimated median wavelet (a value against
  the medians of the 5 and of the 7 values around it), of the values as they are
  and as ratios. Medians keep edges and slopes, so lasting shifts and counter
  resets have no detail, and whatever lasts for three values or less is all
  detail. What recurs at the same time of day (the median detail there) is taken
  off. A value is a spike if, at one of the two scales, its detail is beyond
  `threshold` times the series' usual one both as a difference and as a ratio.
  The usual detail is the 90th percentile of all details of that scale, which a
  few per cent of spikes cannot move.
* Stuck readings: runs of zero detail of the Haar wavelet (neighbours that are
  equal), too long for the series' own habit of repeating.
* Impossible values: outside the bounds of the unit in which a series is measured.

What is usual is counted over the whole series, in logarithmic classes of 1/16
octave, so counts of parts add up. The plan, in stages:

1. Responses are cut by day, values staying in arrays: nothing is exploded. Days
   that were delivered again are dropped, by partial aggregation before the
   exchange, which spreads a series with a third of all rows over its days.
2. Days meet in chunks of `chunk_slots` slots per series, each with `halo_slots`
   slots of its neighbours on both sides, so that a task holds one chunk, bounded
   whatever the series. The usual sizes of a series of several chunks are counted
   in three rounds (sizes, daily course, details and runs), each a sum over
   chunks; a series of one chunk counts its own. Both give the same result.
3. The flagged slots, few, are grouped by series and day and meet the deliveries
   again, of which one byte a value (present or not) is sent, so that a value
   delivered in several rows is flagged in each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship
from .responses import DAY, by_day_parts, canonical_name, present

#: Lowest and highest possible value by unit, the unit being the last word of a path.
UNITS: Mapping[str, tuple[float, float]] = {
    "pct": (0.0, 100.0),
    "percent": (0.0, 100.0),
    "celsius": (-273.15, 1000.0),
    "kelvin": (0.0, 1273.15),
    "bytes": (0.0, 2.0**60),
    "ms": (0.0, 2.0**53),
    "seconds": (0.0, 2.0**53),
    "count": (0.0, 2.0**53),
    "depth": (0.0, 2.0**53),
    "ticks": (0.0, 2.0**53),
    "open": (0.0, 2.0**53),
}
ANY = (-1.7e308, 1.7e308)
SPIKE, STUCK, IMPOSSIBLE = "spike", "stuck", "impossible"

#: Widths of the medians; excursions of up to half of one are all detail.
WIDTHS = (5, 7)
#: The share of details that count as usual; a detail is no less usual than so many steps between neighbours.
USUAL, STEPS = 0.9, 1.25
#: The least usual detail: as a ratio, and as a difference in sizes of the series.
LEAST = 1e-4
#: The size that ratios are taken against, as a share of the sizes that are not 0: the latter if more than 2 % are 0.
SMALL, OFTEN_ZERO = 0.0625, 0.75
#: A time of day has a usual detail if so many days have a value there.
LEAST_DAYS = 5
#: Fewer values than this have no spikes, shorter runs are not stuck.
LEAST_VALUES, LEAST_RUN = 8, 5
#: Of a run too long, so many would be expected; a run that holds more than this share of all values is the normal state.
EXPECTED, HABIT = 1e-3, 0.3


def unit_of(name: Column) -> Column:
    """The last word of a name's path: pct of a.b.cpu.user_pct."""
    return F.lower(F.regexp_extract(F.substring_index(name, ";", 1), r"([A-Za-z]+)$", 1))


def bounds_of(name: Column, units: Mapping[str, tuple[float, float]]) -> tuple[Column, Column]:
    """The lowest and the highest possible value of a series; where the unit is not known any finite one is."""
    out = []
    for i in (0, 1):
        table = F.create_map(*(F.lit(x) for u, ab in units.items() for x in (u.lower(), float(ab[i])))) if units else None
        out.append(F.lit(ANY[i]) if table is None else F.coalesce(F.try_element_at(table, unit_of(name)), F.lit(ANY[i])))
    return out[0], out[1]


# -- wavelets ---------------------------------------------------------------------

#: Exchanges that leave the median of 5 and of 7 in the middle (fixed values).
_NETWORKS = {
    5: ((0, 1), (3, 4), (0, 3), (1, 4), (1, 2), (2, 3), (1, 2)),
    7: ((0, 5), (0, 3), (1, 6), (2, 4), (0, 1), (3, 5), (2, 6), (2, 3), (3, 6), (4, 5), (1, 4), (1, 3), (3, 4)),
}


def median_filter(y: np.ndarray, width: int) -> np.ndarray:
    """The median of the `width` values around each; the ends are mirrored."""
    n, half = len(y), width // 2
    p = np.pad(y, half, mode="symmetric")
    rows = [p[i : i + n] for i in range(width)]
    for a, b in _NETWORKS[width]:
        rows[a], rows[b] = np.minimum(rows[a], rows[b]), np.maximum(rows[a], rows[b])
    return rows[half]


def median_details(y: np.ndarray) -> list[np.ndarray]:
    """Detail coefficients of the undecimated median wavelet, narrow and wide. Monotone stretches and edges have none."""
    return [y - median_filter(y, w) for w in WIDTHS]


def haar_details(y: np.ndarray) -> np.ndarray:
    """Detail coefficients of the undecimated Haar wavelet at its finest scale: one between each two neighbours."""
    return (y[1:] - y[:-1]) / 2


# -- counts of classes ------------------------------------------------------------

_CLASSES, _ZERO = 16, 2**15


def classes(x: np.ndarray) -> np.ndarray:
    """The class of each size, sixteen to an octave, with its sign; 0 is a class of its own."""
    with np.errstate(divide="ignore"):
        c = np.floor(np.log2(np.abs(x)) * _CLASSES)
    c = np.where(np.isfinite(c), c, -_ZERO).astype(np.int64) + _ZERO
    return np.where(x < 0, -c, c)


def size_of(c: np.ndarray | int) -> np.ndarray:
    """The middle of a class."""
    k = np.abs(np.asarray(c, float))
    return np.sign(c) * np.where(k == 0, 0.0, 2.0 ** ((k - _ZERO + 0.5) / _CLASSES))


def quantile(c: np.ndarray, n: np.ndarray | None, q: float) -> float:
    """The size at the rank ceil(q * all) of classes that occur n times (once each where n is None); 0 of nothing."""
    if not len(c):
        return 0.0
    if n is None:
        k = max(int(np.ceil(q * len(c))) - 1, 0)
        return float(size_of(np.partition(c, k)[k]))
    order = np.argsort(c)
    run = np.cumsum(n[order])
    return float(size_of(c[order][np.searchsorted(run, max(np.ceil(q * run[-1]), 1))]))


# -- what is usual for a series ---------------------------------------------------

#: Kinds of counts, by the round in which they are made.
SIZES, RUNS, VALUES = 0, 20, 21
COURSE, DETAILS, JUMPS = 1, 5, 9
_SPAN = 2**17
ROUNDS = 3


class Counts:
    """Classes and how often they occur, by kind; `n` is None where each occurs once (a series of one chunk)."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = {}

    def put(self, kind: int, key: np.ndarray, n: np.ndarray | None = None, m: np.ndarray | None = None) -> None:
        self.of[kind] = (key, n, m)

    def get(self, kind: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        return self.of.get(kind, (np.zeros(0, np.int64), None, None))

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(kind, key, n, m): what is summed over the chunks of a series."""
        out: list[tuple[int, int, int, int]] = []
        for kind, (key, n, m) in self.of.items():
            if n is None:
                key, n = np.unique(key, return_counts=True)
            m = np.zeros(len(key), np.int64) if m is None else m
            out += zip([kind] * len(key), key.tolist(), n.tolist(), m.tolist())
        return out


class Chunk:
    """The present values of one chunk with its halo; `core` are those that are its own."""

    def __init__(self, slot: np.ndarray, x: np.ndarray, core: np.ndarray, step: int, low: float, high: float):
        self.impossible = (x < low) | (x > high) | np.isinf(x)
        self.slot, self.x, self.core = slot, x, core
        ok = ~self.impossible
        self.clean_slot, self.clean, self.clean_core = slot[ok], x[ok], core[ok]
        per_day = DAY // step if DAY % step == 0 else 0
        self.tod = self.clean_slot % per_day if per_day >= 2 else None

    def sizes(self, c: Counts) -> None:
        c.put(SIZES, classes(np.abs(self.clean[self.clean_core])))

    def views(self, c: Counts) -> None:
        """The values as they are and as ratios, and their details."""
        key, n, _ = c.get(SIZES)
        some = key > 0
        total, zeros = (len(key), int((~some).sum())) if n is None else (int(n.sum()), int(n[~some].sum()))
        share = OFTEN_ZERO if zeros > 0.02 * total else SMALL
        unit = quantile(key[some], None if n is None else n[some], share) or 1.0
        self.level = quantile(key, n, 0.5)
        self.ys = (self.clean, np.sign(self.clean) * np.log1p(np.abs(self.clean) / unit))
        self.details = [d for y in self.ys for d in median_details(y)]

    def course(self, c: Counts) -> None:
        if self.tod is not None:
            for i, d in enumerate(self.details):
                c.put(COURSE + i, self.tod[self.clean_core] * _SPAN + classes(d[self.clean_core]) + _ZERO * 2)

    def take_off(self, c: Counts) -> None:
        """The details without what is usual at their time of day."""
        if self.tod is None:
            return
        for i, d in enumerate(self.details):
            key, n, _ = c.get(COURSE + i)
            if not len(key):
                continue
            order = np.argsort(key)
            key, n = key[order], np.ones(len(key), np.int64) if n is None else n[order]
            tod, run = key // _SPAN, np.cumsum(n)
            first = np.flatnonzero(np.diff(tod, prepend=-1))
            before = run[first] - n[first]
            days = np.diff(np.append(before, run[-1]))
            mid = np.searchsorted(run, before + (days + 1) // 2)
            usual = np.where(days >= LEAST_DAYS, size_of(key[mid] % _SPAN - _ZERO * 2), 0.0)
            at = np.minimum(np.searchsorted(tod[first], self.tod), len(first) - 1)
            self.details[i] = d - np.where(tod[first][at] == self.tod, usual[at], 0.0)

    def scales(self, c: Counts) -> None:
        for i, d in enumerate(self.details):
            c.put(DETAILS + i, classes(np.abs(d[self.clean_core])))
        for i, y in enumerate(self.ys):
            c.put(JUMPS + i, classes(np.abs(np.diff(y)[self.clean_core[1:]])))

    def runs(self, c: Counts) -> None:
        """Runs of zero detail that begin in the core: how many, how many repeats; and of each value that repeats."""
        self.begin, self.length = zero_runs(self.x)
        own = self.core[self.begin]
        length, value = self.length[own], self.x[self.begin][own]
        c.put(RUNS, np.zeros(1, np.int64), np.array([len(length)]), np.array([(length - 1).sum()]))
        again = length >= 2
        v, at = np.unique(value[again] + 0.0, return_inverse=True)
        c.put(VALUES, v.view(np.int64), np.bincount(at, minlength=len(v)), np.bincount(at, length[again], len(v)).astype(np.int64))

    def spikes(self, c: Counts, threshold: float) -> np.ndarray:
        """The places of `clean` that are spikes."""
        n = len(self.clean)
        key, m, _ = c.get(DETAILS)
        if (len(key) if m is None else int(m.sum())) < LEAST_VALUES:
            return np.zeros(n, bool)
        ratio = np.full((2, len(WIDTHS), n), 0.0)
        for i, y in enumerate(self.ys):
            jump = STEPS * quantile(*c.get(JUMPS + i)[:2], 0.5)
            floor = max(jump, LEAST if i else LEAST * self.level, 1e-12)
            for j in range(len(WIDTHS)):
                k = i * len(WIDTHS) + j
                ratio[i, j] = np.abs(self.details[k]) / max(quantile(*c.get(DETAILS + k)[:2], USUAL), floor)
        return beside_gaps(self.clean, self.clean_slot, ratio.min(axis=0).max(axis=0) > threshold)

    def stuck(self, c: Counts) -> np.ndarray:
        """The places of `x` in runs too long for the series; zero_runs() of which are known."""
        flag = np.zeros(len(self.x), bool)
        _, runs, repeats = c.get(RUNS)
        if not len(runs):
            return flag
        runs, repeats = int(runs[0]), int(repeats[0])
        key, often, total = c.get(VALUES)
        known = dict(zip(key.tolist(), zip(often.tolist(), total.tolist()))) if len(key) else {}
        for r in np.flatnonzero((self.length >= LEAST_RUN) & (self.length <= HABIT * (runs + repeats))):
            own = int(self.length[r]) - 1
            # the chance that a value repeats, without this run; and that a repeated value like this one goes on
            chance = (repeats - own + 0.5) / (repeats - own + runs + 1)
            times, held = known.get(int((self.x[self.begin[r] : self.begin[r] + 1] + 0.0).view(np.int64)[0]), (0, 0))
            if times >= LEAST_RUN:
                chance = max(chance, (held - 2 * times - (own - 1) + 0.5) / (held - times - own + 1))
            if runs * chance**own < EXPECTED:
                flag[self.begin[r] : self.begin[r] + self.length[r]] = True
        return flag


def zero_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs without Haar detail begin, and how many values they have; single values are runs of one."""
    with np.errstate(invalid="ignore"):
        moved = haar_details(x) != 0  # inf - inf is no number, and no movement
    if np.isinf(x).any():
        moved = x[1:] != x[:-1]
    begin = np.append(0, np.flatnonzero(moved) + 1) if len(x) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(x)))


def beside_gaps(x: np.ndarray, slot: np.ndarray, flag: np.ndarray, k: int = 4) -> np.ndarray:
    """Of excursions beside a gap those stay that are about as far from what is on their two sides.

    Else they are shifts that moved on meanwhile.
    """
    flag = flag.copy()
    idx = np.flatnonzero(flag)
    for part in np.split(idx, np.flatnonzero(np.diff(idx) > 1) + 1) if len(idx) else ():
        a, b = int(part[0]), int(part[-1]) + 1
        around = slot[max(a - k, 0) : b + k]
        if a and b < len(x) and around[-1] - around[0] > 2 * (len(around) - 1):
            off = sorted(abs(np.median(x[part]) - np.median(v)) for v in (x[max(a - k, 0) : a], x[b : b + k]))
            flag[part] = off[0] >= 0.6 * off[1]
    return flag


def count(chunk: Chunk, known: Counts | None, rounds: int) -> Counts:
    """What is usual, from the counts of the rounds already `known`, or else from the chunk itself, up to a number of rounds."""
    c = known or Counts()
    fresh = known is None
    made = Counts()
    if fresh or rounds == 1:
        chunk.sizes(c if fresh else made)
    if rounds >= 2:
        chunk.views(c)
        if fresh or rounds == 2:
            chunk.course(c if fresh else made)
    if rounds >= 3:
        chunk.take_off(c)
        if fresh or rounds == 3:
            chunk.scales(c if fresh else made)
            chunk.runs(c if fresh else made)
    return c if fresh else made


def judge(chunk: Chunk, known: Counts | None = None, threshold: float = 5.5) -> dict[str, np.ndarray]:
    """The chunk's own slots that are implausible, by reason; a slot can have several."""
    with np.errstate(all="ignore"):
        if known is None:
            c = count(chunk, None, ROUNDS)
        else:
            c = known
            chunk.views(c)
            chunk.take_off(c)
            chunk.begin, chunk.length = zero_runs(chunk.x)
        spikes = chunk.spikes(c, threshold)
        stuck = chunk.stuck(c)
    return {
        SPIKE: chunk.clean_slot[spikes & chunk.clean_core],
        STUCK: chunk.slot[stuck & chunk.core],
        IMPOSSIBLE: chunk.slot[chunk.impossible & chunk.core],
    }


# -- over tables ------------------------------------------------------------------

_KEY = ["series", "step"]
_KNOWN = "array<struct<kind:int,key:long,n:long,m:long>>"


def _named(responses: DataFrame, *more) -> DataFrame:
    return responses.select(*more, canonical_name("name").alias("name"), "start", "stop", "step", "vals").where(F.col("name").isNotNull())


def _over_chunks(chunks: DataFrame, made: Callable, schema: str) -> DataFrame:
    """A function of (step, chunk, known counts or None) as rows, over sorted partitions that stream."""
    rows = chunks.repartition(*_KEY, "chunk").sortWithinPartitions(*_KEY, "chunk", "slot0")
    names = [f.split()[0] for f in schema.split(", ")]
    ship(chunks.sparkSession)

    def close(key: tuple, parts: list[tuple[int, np.ndarray]], known: list) -> list[tuple]:
        series, step, low, high, origin, days, chunk = key
        if not parts:
            return []
        first = min(s for s, _ in parts)
        x = np.full(max(s + len(v) for s, v in parts) - first, np.nan)
        for s, v in parts:
            at = slice(s - first, s - first + len(v))
            x[at] = np.fmax(x[at], v)
        seen = np.flatnonzero(~np.isnan(x))
        if not len(seen):
            return []
        lo, hi = (-(-(origin + (chunk + i) * days) * DAY // step) if days else s for i, s in ((0, first), (1, first + len(x))))
        slot = seen + first
        counts = None
        if known is not None:
            counts, by = Counts(), {}
            for k in known:
                by.setdefault(k["kind"], []).append((k["key"], k["n"], k["m"]))
            for kind, rows in by.items():
                counts.put(kind, *(np.array(c, np.int64) for c in zip(*rows)))
        return made(series, step, Chunk(slot, x[seen], (slot >= lo) & (slot < hi), step, low, high), counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, known = None, [], None
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        types = [kinds[f.split()[1]] for f in schema.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in (*_KEY, "low", "high", "origin", "days", "chunk", "slot0")]
            lists = batch.column("part")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))))
            told = batch.column("known") if "known" in batch.schema.names else None
            for i, row in enumerate(zip(*cols)):
                if key is None or row[:2] != key[:2] or row[6] != key[6]:
                    if key is not None:
                        out += close(key, parts, known)
                    key, parts, known = row[:7], [], None
                if told is not None and told[i].is_valid:
                    known = told[i].as_py()
                else:
                    if key[2] is None:  # begun by what is known
                        key = row[:7]
                    parts.append((row[7], flat[ends[i] : ends[i + 1]]))
            yield batch_of(out)
        if key is not None:
            yield batch_of(close(key, parts, known))

    more = [c for c in ("known",) if c in rows.columns]
    return rows.select(*_KEY, "low", "high", "origin", "days", "chunk", "slot0", "part", *more).mapInArrow(run, schema)


def implausible_slots(responses: DataFrame, threshold: float = 5.5, units: Mapping[str, tuple[float, float]] = UNITS, chunk_slots: int = 32768, halo_slots: int = 1024) -> DataFrame:
    """`series, step, slot_ts long, reason string`: the implausible slots of each series.

    `series` is the 64-bit hash of a regular name. Deliveries of one slot that
    disagree count with their largest value. What is usual is counted over the
    whole series, whatever its length. A run of equal readings is measured as far
    as `halo_slots` beyond its chunk.
    """
    name = F.col("name")
    low, high = bounds_of(name, units)
    keyed = _named(responses).select(F.xxhash64(name).alias("series"), low.alias("low"), high.alias("high"), "start", "stop", "step", "vals")
    parts = by_day_parts(keyed, ["series", "low", "high"]).distinct()
    schema = "series long, step long, slot_ts long, reason string"

    def flags(series: int, step: int, chunk: Chunk, known: Counts | None) -> list[tuple]:
        return [(series, step, int(s) * step, reason) for reason, found in judge(chunk, known, threshold).items() for s in found]

    # one small question to the driver: can a series be longer than a chunk at all
    span = responses.where("step > 0").agg((F.max("stop") - F.min("start")).alias("time"), F.min("step").alias("step")).first()
    if span["time"] is None or span["time"] / span["step"] + 2 <= chunk_slots:
        whole = parts.withColumns({"origin": F.lit(0), "days": F.lit(0), "chunk": F.lit(0)})
        return _over_chunks(whole, flags, schema)
    spans = parts.groupBy(*_KEY).agg(F.min("day").alias("origin"), F.max("day").alias("last"))
    days = F.greatest(F.floor(F.lit(chunk_slots) * F.col("step") / DAY), F.lit(1)).cast("int")
    spans = spans.withColumn("days", days).withColumn("chunks", (F.floor((F.col("last") - F.col("origin")) / F.col("days")) + 1).cast("int"))
    halo = F.least(F.greatest(F.ceil(F.lit(halo_slots) * F.col("step") / DAY), F.lit(1)), F.col("days")).cast("int")
    rel = F.col("day") - F.col("origin")
    spots = [F.floor((rel + d) / F.col("days")).cast("int") for d in (-F.col("halo"), F.lit(0), F.col("halo"))]
    held = F.filter(F.array(*spots), lambda c: (c >= 0) & (c < F.col("chunks")))
    cut = parts.join(spans, _KEY).withColumn("halo", halo).select(*_KEY, "low", "high", "origin", "days", "chunks", "slot0", "part", F.explode(F.array_distinct(held)).alias("chunk"))
    several = cut.where("chunks > 1").drop("chunks").withColumn("known", F.lit(None).cast(_KNOWN))
    frames = spans.where("chunks > 1").select(*_KEY, "origin", "days", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    counted: DataFrame | None = None
    for r in range(1, ROUNDS + 1):

        def tally(series: int, step: int, chunk: Chunk, known: Counts | None, r: int = r) -> list[tuple]:
            return [(series, step, *row) for row in count(chunk, known or Counts(), r).rows()]

        new = _over_chunks(_told(several, frames, counted), tally, "series long, step long, kind int, key long, n long, m long")
        new = new.groupBy(*_KEY, "kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        # once per round and series, so that rounds do not run one another again
        counted = checkpoint(new if counted is None else counted.unionByName(new))
    alone = cut.where("chunks = 1").drop("chunks").withColumn("known", F.lit(None).cast(_KNOWN))
    return _over_chunks(alone.unionByName(_told(several, frames, counted)), flags, schema)


def _told(chunks: DataFrame, frames: DataFrame, counted: DataFrame | None) -> DataFrame:
    """The chunks with, before the values of each, a row of what is known of its series."""
    if counted is None:
        return chunks
    known = counted.groupBy(*_KEY).agg(F.collect_list(F.struct("kind", "key", "n", "m")).alias("known"))
    rows = frames.join(known, _KEY).select(
        *_KEY, F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "origin", "days", "chunk", F.lit(-(2**62)).cast("long").alias("slot0"), F.lit(None).cast("array<double>").alias("part"), "known"
    )
    return chunks.unionByName(rows)


def implausible_values(responses: DataFrame, threshold: float = 5.5, units: Mapping[str, tuple[float, float]] = UNITS, **chunks: int) -> DataFrame:
    """`fetch_id long, ts long, reasons array<string>`: each implausible value of each delivery.

    Spikes, stuck readings and impossible values of `vals`, judged against the
    series' own behaviour and the bounds of its unit; see implausible_slots().
    Series of fewer than 8 values have no spikes; runs of fewer than 5 equal
    readings, and runs that hold more than 30 % of a series, are not stuck.
    Responses without a name, a positive step, start, stop or values give
    nothing. Absent values are never flagged. A fetch_id that occurs twice is
    flagged once per value.
    """
    flagged = implausible_slots(responses, threshold, units, **chunks)
    day = F.floor(F.col("slot_ts") / DAY).cast("int").alias("day")
    by_day = (
        flagged.groupBy(*_KEY, day, (F.col("slot_ts") / F.col("step")).cast("long").alias("slot"))
        .agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
        .groupBy(*_KEY, "day")
        .agg(F.collect_list(F.struct("slot", "reasons")).alias("hits"))
    )
    keyed = _named(responses, "fetch_id", F.pmod(F.col("start"), F.nullif(F.col("step"), F.lit(0))).alias("off")).withColumn("series", F.xxhash64("name"))
    sent = by_day_parts(keyed, ["fetch_id", "off", "series"])
    there = sent.withColumn("here", F.transform("part", lambda v: F.coalesce(present(v), F.lit(False)))).drop("part")
    at = there.join(by_day, [*_KEY, "day"]).select("fetch_id", "off", "step", "slot0", "here", F.explode("hits").alias("hit"))
    seen = at.where(F.coalesce(F.get("here", (F.col("hit.slot") - F.col("slot0")).cast("int")), F.lit(False)))
    return seen.select("fetch_id", (F.col("hit.slot") * F.col("step") + F.col("off")).alias("ts"), "hit.reasons").dropDuplicates(["fetch_id", "ts"])


def implausible_found(values: DataFrame) -> DataFrame:
    """`fetch_id long, ts long` of implausible_values()."""
    return values.select("fetch_id", "ts")
