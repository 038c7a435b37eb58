"""A mix of sources at target weights (problem 7).

1. Sizes in tokens come from one pass over the texts; (id, source, size) is
   written to the shared checkpoint folder, as all later steps need only that.
2. Totals per wanted source, as many rows as there are targets, fix how often a
   record of each source is taken: a whole number of copies and a probability.
3. The probabilities become whole by pivotal dependent rounding: two records
   exchange mass at random until one of them is 0 or 1. Records of a source are
   taken by class of size (four to an octave) and, in a class, by hash of the id
   into buckets of about `BUCKET` records, so that mass moves between records of
   nearly one size and the source's total hardly changes, and a source with a
   third of all records is spread over many tasks. Each bucket leaves at most one
   undecided record, and these residuals meet in a tree of two more levels (the
   buckets of a class, the classes of a source). Nothing hangs on how the data
   are partitioned: ids, sizes and the seed fix the mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, ship
from .tokens import DEFAULT_VOCABULARY, count_tokens

_EPS = 1e-9


def source_key(c: Column) -> Column:
    """One spelling per source: lower case, no white space at the ends, runs of hyphens, blanks and underscores as one underscore."""
    return F.lower(F.regexp_replace(F.trim(c), r"[-\s_]+", "_"))


def plan_takes(totals: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """How often a record of each source is taken, on average.

    Shares are scaled to add up to 1 over the sources that have any text. Without
    `total_tokens` the mix is the largest one in which every such source has
    exactly its share. With it, sources that would pass their cap are held there
    and the others share the rest in proportion.
    """
    able = {s: (w, cap, totals[s]) for s, w, cap in targets if w and w > 0 and cap and cap > 0 and totals.get(s, 0) > 0}
    if not able:
        return {}
    weight = sum(w for w, _, _ in able.values())
    if total_tokens is None:
        total_tokens = min(cap * a / (w / weight) for w, cap, a in able.values())
        return {s: min(float(cap), w / weight * total_tokens / a) for s, (w, cap, a) in able.items()}
    take: dict[str, float] = {}
    free, left = dict(able), float(total_tokens)
    while free:
        weight = sum(w for w, _, _ in free.values())
        full = [s for s, (w, cap, a) in free.items() if w / weight * left >= cap * a]
        if not full:
            take |= {s: w / weight * left / a for s, (w, _, a) in free.items()}
            break
        for s in full:
            _, cap, a = free.pop(s)
            take[s] = float(cap)
            left -= cap * a
    return take


def _uniform(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends only on the two ids and the seed."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 29)) * m) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return x / 2.0**64


def pivot(ids: list[int], p: list[float], seed: int) -> tuple[list[float], int]:
    """Pivotal rounding along the list: probabilities as 0.0 or 1.0, and the place of the one left undecided (-1: none)."""
    out = list(p)
    open_at = -1
    for i, q in enumerate(p):
        if q <= _EPS or q >= 1 - _EPS:
            out[i] = float(round(q))
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = out[open_at], q
        s, u = a + b, _uniform(ids[open_at], ids[i], seed)
        if s < 1:  # one of the two gives all it has to the other
            rest, gone = (open_at, i) if u < a / s else (i, open_at)
            out[rest], out[gone] = s, 0.0
        else:  # one of the two is taken whole, the other keeps what is left
            whole, rest = (open_at, i) if u < (1 - b) / (2 - s) else (i, open_at)
            out[whole], out[rest] = 1.0, s - 1
        open_at = rest
        if out[rest] <= _EPS or out[rest] >= 1 - _EPS:
            out[rest] = float(round(out[rest]))
            open_at = -1
    return out, open_at


#: Records of a bucket, about.
BUCKET = 50_000
_COLS = ["doc_id", "source", "n_tokens", "base", "p", "cls", "bucket", "open"]
_KINDS = "doc_id long, source string, n_tokens long, base long, p double, cls long, bucket long, open boolean"


def _level(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """One level of the tree over sorted partitions: of the records of equal keys at most one stays open."""
    place = F.xxhash64("doc_id", F.lit(seed))
    ordered = rows.repartition(*keys).withColumn("__place", place).sortWithinPartitions(*keys, "n_tokens", "__place", "doc_id").drop("__place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
                held = None
            if not len(pdf):
                continue
            done = []
            marks = pdf[keys].to_numpy()
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            groups = np.split(np.arange(len(pdf)), cuts)
            for k, g in enumerate(groups):
                part = pdf.iloc[g].copy()
                p, at = pivot(part["doc_id"].tolist(), part["p"].tolist(), seed)
                part["p"] = p
                part["open"] = False
                if at >= 0 and k == len(groups) - 1:
                    # its group may go on in the next batch
                    held = part.iloc[[at]].copy()
                    part = part.drop(part.index[at])
                elif at >= 0:
                    part.iloc[at, part.columns.get_loc("open")] = True
                done.append(part)
            yield pd.concat(done)[_COLS]
        if held is not None:
            held["open"] = True
            yield held[_COLS]

    ship(rows.sparkSession)
    return ordered.select(*_COLS).mapInPandas(run, _KINDS)


def sized_records(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`doc_id, source, n_tokens` of the records of wanted sources, written to the checkpoint folder."""
    wanted = targets.select(source_key(F.col("source")).alias("source")).where(F.col("source").isNotNull()).distinct()
    rows = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text").where(F.col("doc_id").isNotNull())
    return checkpoint(count_tokens(rows.join(wanted, "source", "left_semi"), ["doc_id", "source"], vocabulary=vocabulary))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 7,
    vocabulary: str = DEFAULT_VOCABULARY,
    records: DataFrame | None = None,
) -> DataFrame:
    """`doc_id long, source string, n_tokens long, copies long`: the records taken, and how often.

    Each source's share of all tokens taken comes as near to its target as whole
    records allow (see plan_takes() for the total). No record is taken more than
    its source's `max_repeats` times. Sources are compared in one spelling; of
    targets with equal spelling shares add up and the smallest cap holds. Null
    sources, null ids, sources without a target and texts without tokens are
    never taken; a target with a null or non-positive share or cap neither. Rows
    that repeat an id are records of their own. Empty tables give an empty result.
    """
    sized = records if records is not None else sized_records(docs, targets, vocabulary)
    usable = sized.where(F.col("n_tokens") > 0)
    # at most one row per target
    goal = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("cap")).where(F.col("source").isNotNull())
    totals = {r["source"]: int(r["n"]) for r in usable.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(goal, "source", "left_semi").collect()}
    takes = plan_takes(totals, [(r["source"], r["w"], r["cap"]) for r in goal.collect()], total_tokens)
    spark = sized.sparkSession
    plan = spark.createDataFrame(
        [(s, int(math.floor(f + _EPS)), float(max(0.0, f - math.floor(f + _EPS)))) for s, f in takes.items()], "source string, base long, p double"
    )
    open_rows = usable.join(F.broadcast(plan), "source").withColumn("cls", F.floor(F.log2("n_tokens") * 4).cast("long"))
    # at most 256 classes of each target
    sizes = open_rows.groupBy("source", "cls").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET)).cast("long").alias("buckets"))
    first = open_rows.join(F.broadcast(sizes), ["source", "cls"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets"))).withColumn("open", F.lit(True))
    one = checkpoint(_level(first, ["source", "cls", "bucket"], seed))
    two = checkpoint(_level(one.where("open"), ["source", "cls"], seed + 10))
    three = _level(two.where("open"), ["source"], seed + 20)
    # the one that is left of a source is decided by a number that depends only on its id and the seed
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed + 20)), F.lit(2**32)).cast("double") / float(2**32)
    tossed = F.when(F.col("open"), F.when(chance < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.col("p"))
    every = one.where(~F.col("open")).unionByName(two.where(~F.col("open"))).unionByName(three.withColumn("p", tossed))
    return every.select("doc_id", "source", "n_tokens", (F.col("base") + F.round("p").cast("long")).alias("copies")).where(F.col("copies") > 0)


def report_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """`source, target_share, actual_share double, tokens, records, copies long`: one row per target."""
    got = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies")
    )
    goal = targets.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    joined = goal.join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    return joined.select(
        "source",
        "target_share",
        F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "records", "copies")),
    )
