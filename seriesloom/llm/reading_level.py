"""How demanding the running prose of each document is (problem 8).

The measure of a document's vocabulary is the coverage rank: the size of the
smallest frequency-ranked vocabulary, of the corpus's words in its language, that
covers a fixed share of the document's words. It is taken for four shares. With
the complexity of the sentences (their length, longest one and spread, commas,
length of words and share of long ones) it is calibrated on the passages: one
Gaussian per language and level, whose moments are aggregates in SQL, first of the
passages and then of all documents by the level these give them. Scores are
built-in expressions.

A document's own content is its sentences that are not found all over a site. A
sentence is around the content, not of it, if on some site it stands on
`common_share` of all distinct pages with prose of their own (`common_least` at
least). A page is known by its longest sentence that is not frequent on its site,
so the copies of a page count once, whole or slightly changed, however many.

The plan, in stages:

1. One pass over the texts makes a slim row per document: hashes, lengths and
   commas of its sentences, hashes and lengths of their words. It is written as a
   table to the shared folder; no later stage reads texts.
2. Built-in aggregates over that table count sentences per site, pages per
   sentence, and words per language; ranks come from the counts of counts.
3. The `head` most frequent words per language, a bounded table, and the common
   sentences go to the workers, which turn slim rows into features batch by batch.
   Where the common sentences are more than `BROADCAST`, a join marks them; where
   the head does not cover a share, the words meet the whole vocabulary in a join.
4. Moments, scores and levels by expressions over the features.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, written

LEVELS = ("basic", "middle", "advanced")
SHARES = (0.6, 0.7, 0.8, 0.9)
#: Words of so many letters are long.
LONG_WORD = 10
#: Rows that may be sent to every worker.
BROADCAST = 2_000_000
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_ELISION = re.compile(r"(?<=\b[ldjnscm])['’]|(?<=\bqu)['’]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"»”’“)\]]*\s+")
_ENDED = re.compile(r"[.!?][\"»”’“)\]\s]*\Z")
_DIGITS = re.compile(r"\d+")


def hash64(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def raw_words(raw: str) -> list[str]:
    """The words in a piece between blanks, in lower case: without marks at the ends, elisions apart."""
    return _ELISION.sub("’ ", _EDGE.sub("", raw.lower())).replace("’ ", " ").split()


class Languages:
    """What the passages show of their languages: letters, and words.

    A word with a letter of no passage was wrongly decoded, or is of another
    script, and is left out. The language of a document is the one whose passages
    know most of its words.
    """

    def __init__(self, passages: list[tuple[str, str]]):
        known: dict[str, set[str]] = {}
        for lang, text in passages:
            known.setdefault(lang, set()).update(w for raw in text.split() for w in raw_words(raw))
        self.names = sorted(known)
        letters = sorted({c for ws in known.values() for w in ws for c in w if c.isalpha()} | set("abcdefghijklmnopqrstuvwxyz"))
        self.pattern = f"[{''.join(letters)}]+(?:-[{''.join(letters)}]+)*\\Z"
        self.known = {w: sum(1 << i for i, lang in enumerate(self.names) if w in known[lang]) for ws in known.values() for w in ws}


class Words:
    """Hash, length and languages of the words in raw pieces, with a memory that is emptied when it is full."""

    def __init__(self, languages: Languages, limit: int = 200_000):
        self.seen: dict[str, tuple[tuple[int, int, int], ...]] = {}
        self.limit, self.known, self.word = limit, languages.known, re.compile(languages.pattern)

    def of(self, raw: str) -> tuple[tuple[int, int, int], ...]:
        hit = self.seen.get(raw)
        if hit is None:
            hit = tuple((hash64(w), len(w), self.known.get(w, 0)) for w in raw_words(raw) if self.word.match(w))
            if len(raw) < 100:
                if len(self.seen) > self.limit:
                    self.seen.clear()
                self.seen[raw] = hit
        return hit


def sentences(text: str | None) -> list[str]:
    """The candidates for prose: three words or more with an end mark, within one line."""
    out = []
    for line in (text or "").split("\n"):
        line = line.strip()
        if line and not line.isspace():
            out += [s for s in _SENTENCE.split(line) if s.count(" ") >= 2 and _ENDED.search(s)]
    return out


def mask(sentence: str) -> int:
    return hash64(_DIGITS.sub("0", sentence.strip()))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


_SLIM = "lang string, sh array<long>, sw array<int>, sc array<int>, sk array<int>, wh array<long>, wl array<int>"


def slim_rows(rows: DataFrame, languages: Languages, least_known: float) -> DataFrame:
    """The columns of `rows` but `text`, and: `lang`; per sentence `sh` hash, `sw` pieces, `sc` commas, `sk` words; per word `wh` hash, `wl` letters."""
    keep = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, *(f.split()[0] for f in _SLIM.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(languages)
        bits = range(len(languages.names))
        for batch in sliced(batches):
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                sh, sw, sc, sk, wh, wl = [], [], [], [], [], []
                votes: Counter = Counter()
                for s in sentences(text):
                    before = len(wh)
                    for raw in s.split():
                        for h, size, known in words.of(raw):
                            wh.append(h)
                            wl.append(size)
                            votes[known] += 1
                    sh.append(mask(s))
                    sw.append(s.count(" ") + 1)
                    sc.append(s.count(","))
                    sk.append(len(wh) - before)
                best = max(((sum(n for k, n in votes.items() if k >> i & 1), -i) for i in bits), default=(0, 0))
                lang = languages.names[-best[1]] if wh and best[0] >= least_known * len(wh) else None
                for col, v in zip(cols, (lang, sh, sw, sc, sk, wh, wl)):
                    col.append(v)
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), longs, ints, ints, ints, longs, ints)))], names=names)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"{kinds}, {_SLIM}")


def common_sentences(slim: DataFrame, share: float, least: int, least_words: int, own_share: float = 1 / 3) -> DataFrame:
    """`h`: the sentences that on some site stand on `share` of the distinct pages with prose of their own.

    `slim` has `row, site, sh, sw`. A page has prose of its own if its sentences
    that are not frequent on its site hold `least_words` pieces and `own_share`
    of all: pages of nothing but notices, errors or copied sentences do not
    count. It is known by the longest of these sentences.
    """
    each = slim.select("row", "site", F.explode(F.arrays_zip("sh", "sw")).alias("s")).groupBy("row", "site", F.col("s.sh").alias("h")).agg(F.max("s.sw").alias("words"))
    limit = F.greatest(F.lit(float(least)), F.lit(share) * F.col("pages"))
    size = slim.where(F.size("sh") > 0).groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    frequent = each.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).join(size, "site").where(F.col("n") >= limit).select("site", "h", F.lit(True).alias("often"))
    # a document's sentences lie together, so that one row a document goes to the exchange
    rare = F.col("often").isNull()
    outline = each.join(frequent, ["site", "h"], "left").groupBy("row", "site").agg(
        F.max(F.when(rare, F.struct("words", "h"))).alias("own"), F.sum(F.when(rare, F.col("words")).otherwise(0)).alias("rare"), F.sum("words").alias("all"), F.collect_list(F.when(~rare, F.col("h"))).alias("hs")
    )
    whole = outline.where(F.col("rare") >= F.greatest(F.lit(float(least_words)), F.lit(own_share) * F.col("all"))).select("site", F.col("own.h").alias("page"), "hs")
    pages = whole.groupBy("site").agg(F.count_distinct("page").alias("pages"))
    stands = whole.select("site", "page", F.explode("hs").alias("h")).distinct().groupBy("site", "h").agg(F.count(F.lit(1)).alias("n"))
    return stands.where(F.col("n") >= least).join(pages, "site").where(F.col("n") >= limit).select("h").distinct()


def word_ranks(words: DataFrame) -> DataFrame:
    """`lang, h, rank` of rows (lang, h, n): the size of the smallest frequency-ranked vocabulary that has the word; ties enter together."""
    w = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    by_count = words.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("k")).select("lang", "n", F.sum("k").over(w).alias("rank"))
    return words.join(by_count, ["lang", "n"]).select("lang", "h", "rank")


class Head:
    """The most frequent words of each language with their ranks, and how many words there are."""

    def __init__(self, top: pd.DataFrame, sizes: dict[str, int]):
        self.sizes, self.of = sizes, {}
        for lang, g in top.sort_values("h").groupby("lang"):
            self.of[lang] = (g["h"].to_numpy(np.int64), g["rank"].to_numpy(np.int64))

    def ranks(self, lang: str, h: np.ndarray) -> np.ndarray:
        """One more than the vocabulary's size for words the head lacks."""
        out = np.full(len(h), self.sizes.get(lang, 0) + 1, np.int64)
        keys, ranks = self.of.get(lang, (np.zeros(0, np.int64),) * 2)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[hit] = ranks[at[hit]]
        return out


def coverage_ranks(doc: np.ndarray, rank: np.ndarray, n_docs: int, shares: tuple[float, ...] = SHARES) -> np.ndarray:
    """For each document the least rank such that a share of its words is not beyond it; NaN without words."""
    n = np.bincount(doc, minlength=n_docs)
    start = np.cumsum(n) - n
    ordered = np.append(rank[np.lexsort((rank, doc))], 0).astype(float)
    at = [np.where(n > 0, start + np.ceil(q * n).astype(np.int64) - 1, len(ordered) - 1) for q in shares]
    return np.where(n > 0, ordered[np.array(at)], np.nan).T


def features(lang: list[str | None], cols: dict[str, tuple[np.ndarray, np.ndarray]], kept: np.ndarray, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document the features, the number of words, words per sentence; per word of kept sentences its document and its place.

    `cols` has values and offsets of the arrays of slim rows; `kept` says which
    sentences are own content.
    """
    (sw, so), sc, sk = cols["sw"], cols["sc"][0], cols["sk"][0]
    (wh, _), wl = cols["wh"], cols["wl"][0]
    n_docs = len(so) - 1
    doc_of = np.repeat(np.arange(n_docs), np.diff(so))
    at = np.flatnonzero(np.repeat(kept, sk))
    doc = np.repeat(doc_of, sk)[at]
    rank = np.zeros(len(at), np.int64)
    langs = np.array([x or "" for x in lang], object)[doc]
    for name in set(lang) - {None}:
        mine = langs == name
        rank[mine] = head.ranks(name, wh[at[mine]])
    cover = coverage_ranks(doc, rank, n_docs)
    total = np.bincount(doc, minlength=n_docs)
    s_doc, size, commas = doc_of[kept], sw[kept].astype(float), sc[kept]
    k = np.bincount(s_doc, minlength=n_docs)
    with np.errstate(all="ignore"):
        mean = np.bincount(s_doc, size, n_docs) / k
        longest = np.zeros(n_docs)
        np.maximum.at(longest, s_doc, size)
        logs = np.log(size)
        spread = np.sqrt(np.maximum(np.bincount(s_doc, logs**2, n_docs) / k - (np.bincount(s_doc, logs, n_docs) / k) ** 2, 0))
        style = (np.log(mean), np.log1p(np.bincount(s_doc, commas, n_docs) / k), np.bincount(doc, wl[at], n_docs) / total, spread, np.log(longest), np.bincount(doc, wl[at] >= LONG_WORD, n_docs) / total)
        x = np.column_stack([np.log(np.maximum(cover, 1)), *style])
    return x, total, mean, doc, at


def quadratics(params: dict[str, list]) -> dict[str, list[tuple[str, float, np.ndarray, np.ndarray]]]:
    """Each Gaussian's score as a name, a constant, weights of the features, and a matrix of weights of their products."""
    out = {}
    for lang, gs in params.items():
        rows = []
        for name, mu, u, c in gs:
            m, q = np.array(mu), np.array(u).T @ np.array(u)
            rows.append((name, float(c - 0.5 * m @ q @ m), q @ m, -0.5 * q))
        out[lang] = rows
    return out


def first_levels(lang: list[str | None], x: np.ndarray, ok: np.ndarray, params: dict[str, list]) -> list[str | None]:
    """scored() for a batch at hand."""
    out: list[str | None] = [None] * len(lang)
    for name, gs in quadratics(params).items():
        at = np.flatnonzero(ok & np.array([v == name for v in lang], bool))
        if len(at):
            y = x[at]
            best = np.argmax([c + y @ w + np.einsum("ij,jk,ik->i", y, q, y) for _, c, w, q in gs], axis=0)
            for i, k in zip(at, best):
                out[i] = gs[k][0]
    return out


def told_common(common: DataFrame):
    """The common sentences as a broadcast array, None where they are too many for that."""
    if common.limit(BROADCAST + 1).count() > BROADCAST:
        return None
    return common.sparkSession.sparkContext.broadcast(np.sort(np.array([r["h"] for r in common.toLocalIterator()], np.int64)))


def featured(slim: DataFrame, common: DataFrame, told, head: Head, least_words: int, exact: bool, params: dict[str, list] | None = None) -> DataFrame:
    """The slim rows with `n_words, words_per_sentence, x` (the features) and, where `exact` and the head does not cover a share, `hs, ns` (its words).

    With `params` their `level` is set by these Gaussians.
    """
    spark = slim.sparkSession
    keep = [c for c in slim.columns if c not in ("sh", "sw", "sc", "sk", "wh", "wl", *(["level"] if params else []))]
    if told is None:
        found = slim.select("row", F.explode(F.array_distinct("sh")).alias("h")).join(common, "h").groupBy("row").agg(F.collect_list("h").alias("hits"))
        slim = slim.join(found, "row", "left")
    shared = spark.sparkContext.broadcast(head)
    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    more = ["n_words long", "words_per_sentence double", "x array<double>", "hs array<long>", "ns array<long>", *(["level string"] if params else [])]
    names = [*keep, *(m.split()[0] for m in more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in sliced(batches):
            cols = {}
            for c in ("sh", "sw", "sc", "sk", "wh", "wl"):
                a = batch.column(c)
                cols[c] = a.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False)))
            sh, so = cols["sh"]
            if told is not None:
                kept = ~np.isin(sh, told.value)
            else:
                hits = [set(h or ()) for h in batch.column("hits").to_pylist()]
                kept = np.array([h not in hits[d] for d, h in zip(np.repeat(np.arange(len(so) - 1), np.diff(so)), sh.tolist())], bool)
            lang = batch.column("lang").to_pylist()
            x, total, mean, doc, at = features(lang, cols, kept, head)
            ok = (total >= least_words) & np.array([v is not None for v in lang], bool)
            beyond = ok & exact & np.array([v is not None and np.expm1(r) >= head.sizes.get(v, 0) - 0.5 for v, r in zip(lang, x[:, len(SHARES) - 1])], bool)
            hs, ns = [None] * len(lang), [None] * len(lang)
            for d in np.flatnonzero(beyond):
                h, n = np.unique(cols["wh"][0][at[doc == d]], return_counts=True)
                hs[d], ns[d] = h.tolist(), n.tolist()
            made = [pa.array(total, pa.int64()), pa.array(np.where(ok, mean, np.nan), pa.float64(), from_pandas=True), pa.array([row if k else None for row, k in zip(x.tolist(), ok)], pa.list_(pa.float64()))]
            made += [pa.array(hs, pa.list_(pa.int64())), pa.array(ns, pa.list_(pa.int64()))]
            if params:
                made.append(pa.array(first_levels(lang, x, ok, params), pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=names)

    ship(spark)
    return slim.mapInArrow(run, f"{kinds}, {', '.join(more)}")


def _beyond_head(prof: DataFrame, ranks: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Puts the exact coverage ranks into `x` where the head of the vocabulary did not reach."""
    words = prof.where(F.col("hs").isNotNull()).select("row", "lang", F.explode(F.arrays_zip("hs", "ns")).alias("w")).select("row", "lang", F.col("w.hs").alias("h"), F.col("w.ns").alias("n"))
    size = F.lit(0)
    for lang, n in sizes.items():
        size = F.when(F.col("lang") == lang, n).otherwise(size)
    met = words.join(ranks, ["lang", "h"], "left").withColumn("rank", F.coalesce("rank", size + 1))
    w = Window.partitionBy("row").orderBy("rank", "h").rowsBetween(Window.unboundedPreceding, 0)
    run = met.select("row", "rank", F.sum("n").over(w).alias("c"), F.sum("n").over(Window.partitionBy("row")).alias("t"))
    exact = run.groupBy("row").agg(*(F.min(F.when(F.col("c") >= F.ceil(F.lit(q) * F.col("t")), F.col("rank"))).alias(f"r{i}") for i, q in enumerate(SHARES)))
    joined = prof.join(exact, "row", "left")
    fixed = F.concat(F.array(*(F.ln(F.col(f"r{i}").cast("double")) for i in range(len(SHARES)))), F.slice("x", F.lit(len(SHARES) + 1), F.size("x") - len(SHARES)))
    return joined.withColumn("x", F.when(F.col("r0").isNotNull(), fixed).otherwise(F.col("x"))).drop(*(f"r{i}" for i in range(len(SHARES))))


DIMENSIONS = len(SHARES) + 6


def moments(rows: DataFrame) -> dict[tuple[str, str], tuple[int, np.ndarray, np.ndarray]]:
    """Number, means and covariances of the features per language and level: as many rows as there are levels in all languages."""
    x = [F.col("x")[i] for i in range(DIMENSIONS)]
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
    got = rows.where(F.col("x").isNotNull() & F.col("level").isin(*LEVELS) & F.col("lang").isNotNull()).groupBy("lang", "level").agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.avg(v) for v in x)).alias("mean"), F.array(*(F.covar_pop(x[i], x[j]) for i, j in pairs)).alias("cov")
    )
    out = {}
    for r in got.collect():
        c = np.zeros((DIMENSIONS, DIMENSIONS))
        for (i, j), v in zip(pairs, r["cov"]):
            c[i, j] = c[j, i] = v
        out[r["lang"], r["level"]] = (r["n"], np.array(r["mean"]), c)
    return out


def gaussians(fit: dict, more: dict | None = None, shrink: float = 0.2, floor: float = 0.05, least: int = 3) -> dict[str, list]:
    """Per language (name, means, factor, constant) of each level: of labelled passages, or of passages and documents together.

    Covariances of passages are drawn towards a fixed small one; documents count
    by their number, passages by theirs.
    """
    out: dict[str, list] = {}
    for (lang, level), (n, mu, c) in sorted(fit.items()):
        if n < least:
            continue
        c = c * n / max(n - 1, 1) * (1 - shrink) + shrink * floor * np.eye(len(mu))
        if more and (lang, level) in more:
            k, mean, cov = more[lang, level]
            c = (n * c + k * (cov + 1e-3 * np.eye(len(mu)))) / (n + k)
            mu = (n * mu + k * mean) / (n + k)
        low = np.linalg.cholesky(np.linalg.inv(c))
        out.setdefault(lang, []).append((level, mu.tolist(), low.T.tolist(), float(-0.5 * np.linalg.slogdet(c)[1])))
    return out


def scored(df: DataFrame, params: dict[str, list]) -> DataFrame:
    """Sets `level`: the best Gaussian of the document's language over the array `x`; null where that is.

    A score is a constant, a weight of each feature and one of each product of
    two, so it is one sum over an array that a document makes once.
    """
    spark = df.sparkSession
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
    table = [(lang, [(name, c, [*w.tolist(), *(float(q[i, j] * (1 if i == j else 2)) for i, j in pairs)]) for name, c, w, q in gs]) for lang, gs in quadratics(params).items()]
    few = F.broadcast(spark.createDataFrame(table, "lang string, g array<struct<name:string,c:double,w:array<double>>>"))  # one row per language
    products = F.flatten(F.transform("x", lambda v, i: F.transform(F.slice("x", F.lit(1), i + 1), lambda other: v * other)))
    terms = F.concat("x", products)
    out = df.drop("level").join(few, "lang", "left").withColumn("__terms", terms)

    def score(g: Column) -> Column:
        return F.struct((g["c"] + F.aggregate(F.zip_with("__terms", g["w"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("s"), g["name"].alias("name"))

    best = F.array_max(F.transform("g", score))
    return out.withColumn("level", F.when(F.col("x").isNotNull(), best["name"])).drop("g", "__terms")


def site_of(docs: DataFrame) -> Column:
    """The host of `url` where the table has that column, else `source`, else one site for all."""
    if "url" in docs.columns:
        return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def reading_levels(
    docs: DataFrame,
    passages: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    common_share: float = 0.004,
    common_least: int = 5,
    least_words: int = 20,
    least_known: float = 0.2,
    head: int = 200_000,
    fit_rows: int = 5_000,
) -> DataFrame:
    """`key, lang string, n_words long, rank_60, rank_70, rank_80, rank_90, words_per_sentence double, level, reason string`.

    One row per document. `lang` is read from the text, not from the column of
    that name: the language whose passages know most of its words, and a share of
    `least_known` at least. The level is null, as are the ranks, where there is
    no measure, and `reason` says why: `short` for less than `least_words` words
    of own prose (error pages, listings, code and character samples, null, empty
    and blank texts), `language` for a language without passages, `passages` for
    one without three passages of any level. Of the passages the first `fit_rows`
    by id are used, rows with nulls are not. Repeated keys are documents of their
    own; other columns are not read.
    """
    fit = [(r["lang"], r["level"], r["text"]) for r in passages.orderBy("passage_id").limit(fit_rows).select("lang", "level", "text").collect()]
    fit = [r for r in fit if r[0] and r[1] in LEVELS and r[2]]
    languages = Languages([(lang, t) for lang, _, t in fit])
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    labelled = spark.createDataFrame([(None, None, level, t) for _, level, t in fit], f"key {kind}, site string, level string, text string")
    rows = docs.select(F.col(key).alias("key"), site_of(docs).alias("site"), F.lit(None).cast("string").alias("level"), F.col(text).cast("string").alias("text"))
    slim = written(slim_rows(rows.unionByName(labelled), languages, least_known).withColumn("row", F.monotonically_increasing_id()))
    own = slim.where("site is not null")
    common = written(common_sentences(own.select("row", "site", "sh", "sw"), common_share, common_least, least_words))
    words = own.where("lang is not null").select("lang", F.explode("wh").alias("h")).groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    ranks = written(word_ranks(words))
    sizes = {r["lang"]: int(r["k"]) for r in ranks.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}
    exact = any(n > head for n in sizes.values())
    # at most `head` rows per language, as ties count with their highest rank
    top = Head(ranks.where(F.col("rank") <= head).toPandas(), sizes)
    told = told_common(common)

    def profiles(rows: DataFrame, params: dict[str, list] | None = None) -> DataFrame:
        prof = featured(rows, common, told, top, least_words, exact, None if exact else params)
        return written(_beyond_head(written(prof), ranks, sizes) if exact else prof)

    first = moments(profiles(slim.where("site is null")))
    params = gaussians(first)
    mine = profiles(own, params)
    if params:
        params = gaussians(first, moments(scored(mine, params) if exact else mine))
    named = scored(mine, params)
    short = F.col("n_words") < least_words
    reason = F.when(F.col("level").isNull(), F.when(short, "short").when(F.col("lang").isNull(), "language").otherwise("passages"))
    return named.select(
        F.col("key").alias(key), "lang", "n_words",
        *(F.exp(F.col("x")[i]).alias(f"rank_{round(100 * q)}") for i, q in enumerate(SHARES)),
        "words_per_sentence", "level", reason.alias("reason"),
    )


def level_found(levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key, level` of the documents whose own content is prose."""
    return levels.where(F.col("level").isNotNull()).select(key, "level")
