"""The operators of the subpackage against plain versions, and on awkward rows."""

import math
import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import mixing, percentiles, reading_level, survivor, tokens

VOCABULARY = Path(tokens.DEFAULT_VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary file here")
DOCS = "doc_id long, source string, text string"

AWKWARD = [
    "", " ", "   ", "\n\n", "a", "Hello world", " lead", "trail ", "two  spaces", "tab\tand\nline \n mix", "it's we'LL 're", "naïve café 漢字 emoji 😀‍👩", "<|endoftext|> <unk> ⁇ ▁x",
    "x\x00y\x1c\x1fz", "1234567890 3.14", "a" * 5000, "\xa0nbsp\xa0 x", "é​﻿", "ﬁ Ω ²", "\r\n \r\n", "ab " * 2000,
]


@needs_vocabulary
def test_ids_equal_those_of_another_library(spark):
    import tiktoken

    ranks = tokens.read_ranks(str(VOCABULARY))
    ref = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={b: i for i, b in enumerate(ranks)}, special_tokens={})
    rng = random.Random(2)
    pool = "ab c'd\n\t\x85é漢😀1²  .,-ſİ Z"
    texts = AWKWARD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    rows = [(i, "s", t) for i, t in enumerate(texts)] + [(-1, "s", None), (None, None, "a"), (0, "s", "again")]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash"))
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_texts(df).collect()]
    want = [(k, ref.encode_ordinary(t) if t else []) for k, _, t in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(tokens.encode_texts(df.where("doc_id > 0"))).collect()}
    assert all(back[i] == t for i, t in enumerate(texts) if i > 0)
    counts = {(r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(df.where("doc_id > 0"), ["doc_id"]).collect()}
    assert counts == {(k, len(ids)) for k, ids in want if k is not None and k > 0}
    assert tokens.encode_texts(spark.createDataFrame([], DOCS)).count() == 0


@needs_vocabulary
def test_memory_of_the_encoder_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    model = tokens.serialise_model(tokens.read_ranks(str(VOCABULARY)))
    small, texts = tokens.Encoder(model), [f"word{i} and {i * i} more" for i in range(50)]
    monkeypatch.setattr(tokens, "MEMORY", 10**6)
    assert [small.encode(t) for t in texts] == [tokens.Encoder(model).encode(t) for t in texts]


RESP = "response_id long, server string, name string, path_expr string, start long, stop long, step long, vals array<double>, cons_func string, xff double, received_at timestamp"
T = datetime(2024, 3, 1)


def servers(spark):
    return spark.createDataFrame([("a", 2, "x"), ("b", 1, "x"), ("c", 3, "x")], "server string, trust_rank int, protocol string")


def brute_survivors(rows, trust):
    groups, out = {}, set()
    for r in rows:
        if r["name"] is not None:
            path, *tags = r["name"].strip().split(";")
            key = (".".join(x for x in path.split(".") if x), tuple(sorted(tags)), r["start"] // 3600, r["stop"] // 3600)
            groups.setdefault(key, []).append(r)
    for g in groups.values():
        if len(g) < 2:
            continue
        gid = min(r["response_id"] for r in g)

        def order(r):
            s = (r["server"] or "").lower().split(":")[0]
            return (r["received_at"] is not None, r["received_at"] or T, -trust.get(s, 10**9), -r["response_id"])

        def full(r):
            return sum(v is not None and v == v and r["start"] + i * r["step"] < r["stop"] for i, v in enumerate(r["vals"] or []))

        some = [r for r in g if full(r)]
        if some:
            out.add((gid, "vals", max(some, key=lambda r: (full(r), order(r)))["response_id"]))
        for f in ("path_expr", "cons_func", "xff"):
            some = [r for r in g if r[f] is not None and r[f] == r[f]]
            if some:
                out.add((gid, f, max(some, key=order)["response_id"]))
    return out


def random_responses(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([0, 0, 30, 3600])
        rows.append(dict(
            response_id=i + 1, server=rng.choice(["a", "A", "b:80", "B", "c", "zz", None]), name=rng.choice(["x.y;k=1;j=2", " x..y;j=2;k=1", "x.z", ".x.z.", "solo%d" % i, None]),
            path_expr=rng.choice([None, "p", "q"]), start=start, stop=start + 7200 - (5 if start == 30 else 0), step=1800, vals=rng.choice([None, [], [1.0, None, float("nan")], [1.0, 2.0], [1.0] * 4, [1.0] * 9]),
            cons_func=rng.choice([None, "sum", "max"]), xff=rng.choice([None, float("nan"), 0.0, 0.5]), received_at=rng.choice([None, T, T + timedelta(hours=rng.randint(0, 3))]),
        ))
    return rows


def as_df(spark, rows):
    names = [c.split()[0] for c in RESP.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], RESP)


def test_survivors_against_a_plain_version(spark):
    rows = random_responses(150, 4)
    df = as_df(spark, rows).withColumn("rank", F.lit("clash")).withColumn("key", F.lit(1))
    got = {tuple(r) for r in survivor.survivors(df, servers(spark), "earliest").collect()}
    assert got == brute_survivors(rows, {"a": 2, "b": 1, "c": 3})


def test_learned_precedence_places_undated_values(spark):
    def r(i, name, cons, at):
        return dict(response_id=i, server="a", name=name, path_expr=None, start=0, stop=3600, step=1800, vals=[1.0], cons_func=cons, xff=None, received_at=at)

    # elsewhere max is followed by sum, again and again
    rows = [x for k in range(5) for x in (r(10 * k + 1, f"t{k}", "max", T), r(10 * k + 2, f"t{k}", "sum", T + timedelta(hours=1)))]
    rows += [r(101, "u", "max", T), r(102, "u", "sum", None)]  # the undated one follows
    rows += [r(201, "w", "sum", T), r(202, "w", "max", None)]  # the undated one precedes
    rows += [r(301, "n", "max", None), r(302, "n", "sum", None)]  # no time at all
    got = {(x["group_id"], x["response_id"]) for x in survivor.survivors(as_df(spark, rows), servers(spark), "learned").collect() if x["field"] == "cons_func"}
    assert {(101, 102), (201, 201), (301, 302)} <= got
    plain = {(x["group_id"], x["response_id"]) for x in survivor.survivors(as_df(spark, rows), servers(spark), "earliest").collect() if x["field"] == "cons_func"}
    assert {(101, 101), (201, 201), (301, 301)} <= plain
    records = {x["group_id"]: x for x in survivor.surviving_records(as_df(spark, rows), servers(spark)).collect()}
    assert records[101]["cons_func"] == "sum" and records[101]["vals"] == [1.0] and records[101]["path_expr"] is None


def brute_precedence(votes):
    """Strongest paths by trying every value in between (Floyd and Warshall), as {(a, b): strength}."""
    values = sorted({v for pair in votes for v in pair})
    p = {(a, b): votes.get((a, b), 0) if votes.get((a, b), 0) > votes.get((b, a), 0) else 0 for a in values for b in values}
    for m in values:
        for a in values:
            for b in values:
                if len({a, b, m}) == 3:
                    p[a, b] = max(p[a, b], min(p[a, m], p[m, b]))
    return {k: s for k, s in p.items() if s > p[k[::-1]]}


def test_precedence_is_a_partial_order(spark):
    rng = random.Random(12)
    for n in (3, 6, 9):
        votes = {(a, b): rng.randint(1, 9) for a in range(n) for b in range(n) if a != b and rng.random() < 0.5}
        df = spark.createDataFrame([("f", f"v{a}", f"v{b}", k) for (a, b), k in votes.items()], "field string, a string, b string, votes long")
        got = {(int(r["a"][1:]), int(r["b"][1:])): r["strength"] for r in survivor.precedence(df).collect()}
        assert got == brute_precedence(votes)
        assert all((b, a) not in got for a, b in got) and all((a, c) in got for a, b in got for x, c in got if x == b)


def test_planted_currency_is_recovered(spark):
    """Values change in one order; a fifth of the times is missing, and some changes go the wrong way."""
    rng = random.Random(21)
    order = ["first", "last", "min", "max", "sum", "average"]
    rows, truth = [], {}
    for g in range(300):
        i = rng.randint(0, 3)
        j = rng.randint(i + 1, min(i + 3, 5))
        steps = [order[i], order[j]] if rng.random() < 0.9 else [order[j], order[i]]  # noise in the dated ones
        lost = g % 5 == 0  # the later value of every fifth group has no time
        if lost:
            steps = [order[i], order[j]]
        for k, v in enumerate(steps):
            rows.append(dict(response_id=10 * g + k + 1, server="a", name=f"n{g}", path_expr=None, start=0, stop=3600, step=1800, vals=[1.0], cons_func=v, xff=None, received_at=None if lost and k else T + timedelta(hours=k)))
        if lost:
            truth[10 * g + 1] = 10 * g + 2
    got = {r["group_id"]: r["response_id"] for r in survivor.survivors(as_df(spark, rows), servers(spark), "learned").collect() if r["field"] == "cons_func"}
    assert sum(got[g] == want for g, want in truth.items()) >= 0.95 * len(truth)
    plain = {r["group_id"]: r["response_id"] for r in survivor.survivors(as_df(spark, rows), servers(spark), "earliest").collect() if r["field"] == "cons_func"}
    assert sum(plain[g] == want for g, want in truth.items()) == 0


def test_precedence_reaches_over_values_a_group_lacks(spark):
    def r(i, name, cons, at):
        return dict(response_id=i, server="a", name=name, path_expr=None, start=0, stop=3600, step=1800, vals=[1.0], cons_func=cons, xff=None, received_at=at)

    rows = [x for k in range(3) for x in (r(10 * k + 1, f"s{k}", "a", T), r(10 * k + 2, f"s{k}", "b", T + timedelta(hours=1)))]
    rows += [x for k in range(3) for x in (r(100 + 10 * k, f"t{k}", "b", T), r(101 + 10 * k, f"t{k}", "c", T + timedelta(hours=1)))]
    rows += [r(200, "u", "a", None), r(201, "u", "c", None)]  # a before b before c
    got = {x["group_id"]: x["response_id"] for x in survivor.survivors(as_df(spark, rows), servers(spark), "learned").collect() if x["field"] == "cons_func"}
    assert got[200] == 201


def test_no_groups(spark):
    empty = spark.createDataFrame([], RESP)
    for how in ("earliest", "learned"):
        assert survivor.survivors(empty, servers(spark), how).count() == 0
    assert survivor.survivors(as_df(spark, random_responses(1, 1)), servers(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        survivor.survivors(empty, servers(spark), "otherwise")


CODES = percentiles.Codes(0.001)
SHAPE = percentiles.DyadicSketch(CODES.bits, 4096, 5)
SMALL = percentiles.DyadicSketch(CODES.bits, 256, 5)


def test_codes_keep_order_and_error():
    v = np.concatenate([np.linspace(-1e6, 1e6, 4001), np.logspace(-300, 308, 5000), -np.logspace(-300, 308, 500), [0.0, -0.0, 1e-320, 1.7976931348623157e308, 2.0**64]])
    for codes in (CODES, percentiles.Codes()):
        c = codes.encode(np.sort(np.append(v, [np.inf, -np.inf])))
        assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 2**codes.bits
        inner = v[np.abs(v) > 3e-308]
        assert (np.abs(codes.decode(codes.encode(inner)) - inner) <= 1.01 * codes.alpha * np.abs(inner)).all()
        assert codes.decode(codes.encode(np.array([np.inf, -np.inf, 0.0, 1e-310]))).tolist() == [np.inf, -np.inf, 0.0, 0.0]


def test_sizes_follow_from_the_error():
    assert percentiles.sized(0.01, 0.01, 24) == (4096, 5)
    assert percentiles.sized(0.1, 0.01, 24)[0] < 4096 < percentiles.sized(0.001, 0.01, 24)[0]
    assert percentiles.sized(0.01, 1e-6, 24)[1] > 5
    with pytest.raises(ValueError):
        percentiles.sized(0, 0.1, 24)


def ranks_hold(xs, row, alpha, slack=0.0):
    xs = np.sort(xs)
    for q, c in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")):
        near = alpha * abs(row[c]) * 1.01 + 1e-300
        lo, hi = np.searchsorted(xs, row[c] - near, "left") / len(xs), np.searchsorted(xs, row[c] + near, "right") / len(xs)
        if not lo - row["rank_error"] - slack <= q <= hi + row["rank_error"] + slack + 1 / len(xs):
            return False
    return True


@pytest.mark.parametrize("shape", [SHAPE, SMALL], ids=["lists", "sketches"])
def test_percentiles_within_the_stated_error(spark, shape):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(100, 15, 20000), "skewed": np.exp(rng.normal(0, 2, 5000)), "few": np.array([1.0, 2.0, 3.0]), "one": np.full(500, 7.0), "signed": rng.normal(0, 1, 3000), "half": np.append(np.full(5000, 7.0), np.exp(rng.normal(0, 3, 5000)))}
    rows = [(k, xs[i : i + 700].tolist()) for k, xs in groups.items() for i in range(0, len(xs), 700)] + [("normal", [None, float("nan")]), ("normal", None), ("normal", []), (None, [5.0])]
    df = spark.createDataFrame(rows, "g string, vals array<double>").withColumn("sketch", F.lit("clash"))
    merged = percentiles.merge_sketches(percentiles.build_sketches(df, ["g"], CODES, shape), ["g"], shape)
    got = {r["g"]: r for r in percentiles.percentiles(merged, ["g"], CODES, shape).collect()}
    assert set(got) == {*groups, None} and got[None]["n"] == 1 and got[None]["rank_error"] == 0
    for k, xs in groups.items():
        assert got[k]["n"] == len(xs) and ranks_hold(xs, got[k], CODES.alpha), k
    assert (got["skewed"]["rank_error"] > 0) == (shape is SMALL) and got["one"]["rank_error"] == 0


def test_the_sketched_levels_keep_their_bound():
    rng = np.random.default_rng(8)
    off, stated = [], []
    for i in range(30):
        xs = np.exp(rng.normal(0, 3, 4000))
        s = SMALL.build(CODES.encode(xs))
        assert s.level < CODES.bits and len(s.cells) <= SMALL.width
        for q in (0.1, 0.5, 0.9, 0.99):
            got = float(CODES.decode(SMALL.code_at(s, q)))
            off.append(abs(np.searchsorted(np.sort(xs), got) / len(xs) - q) - 0.01)
            stated.append(SMALL.rank_error(s))
    assert np.mean(np.array(off) <= np.array(stated)) >= 0.97 and max(stated) < 0.2


def test_sketches_add_up_and_take_away(spark):
    rng = np.random.default_rng(4)
    for shape in (SHAPE, SMALL):
        parts = [CODES.encode(np.exp(rng.normal(0, 2, n))) for n in (3000, 40, 900)]
        whole = shape.build(np.concatenate(parts))
        for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
            s = shape.build(parts[order[0]])
            for k in order[1:]:
                s = shape.add(s, shape.build(parts[k]))
            assert shape.pack(s) == shape.pack(whole) and s.n == 3940
        back = shape.unpack(shape.pack(whole))
        assert back.level == whole.level and (back.rows == whole.rows).all() and (back.cells == whole.cells).all()
        gone = shape.add(whole, shape.build(parts[0], np.full(3000, -1)))
        want = shape.build(np.concatenate(parts[1:]))
        assert gone.n == 940 and abs(CODES.decode(shape.code_at(gone, 0.5)) / CODES.decode(shape.code_at(want, 0.5)) - 1) < 0.2
    rows = [("a", d, rng.normal(50, 20, 500).tolist(), 1) for d in range(4)]
    df = spark.createDataFrame(rows, "g string, day int, vals array<double>, sign int")
    build = lambda x: percentiles.merge_sketches(percentiles.build_sketches(x, ["g"], CODES, SHAPE, sign="sign"), ["g"], SHAPE, F.pmod(F.xxhash64("sketch"), F.lit(2))).first()
    less = df.unionByName(df.where("day = 1").withColumn("sign", F.lit(-1)))
    assert build(less)["sketch"] == build(df.where("day <> 1"))["sketch"]


def test_percentiles_of_responses(spark):
    resp = "name string, path_expr string, start long, stop long, step long, vals array<double>, day string"
    rows = [("x.y", "p", 0, 86400, 43200, [1.0, 2.0, 99.0], "c"), (" x..y", None, 86400, 172800, 43200, [3.0, None], "c"), ("z", None, 0, 60, 60, [8.0], "c"), (None, None, 0, 60, 60, [9.0], "c"), ("x.y", "p", 0, 60, None, [1.0], "c"), ("x.y", "p", 0, 60, 60, [], "c")]
    series = spark.createDataFrame([("x.y", "p"), (None, "q")], "name string, path_expr string")
    got = {(r["path_expr"], str(r["day"])): (r["n"], round(r["p50"], 2)) for r in percentiles.series_percentiles(spark.createDataFrame(rows, resp), series).collect()}
    assert got == {("p", "1970-01-01"): (2, 1.0), ("p", "1970-01-02"): (1, 3.0), ("p", "None"): (3, 2.0), (None, "1970-01-01"): (2, 8.0), (None, "None"): (2, 8.0)}
    assert percentiles.series_percentiles(spark.createDataFrame([], resp), series).count() == 0


def test_pivotal_rounding_keeps_sums_and_chances():
    rng = random.Random(1)
    for _ in range(200):
        p = [rng.random() for _ in range(rng.randint(0, 30))]
        out, at = mixing.pivot(list(range(len(p))), p, rng.randint(0, 10**9))
        assert abs(sum(out) - sum(p)) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != at)
    hits = np.zeros(5)
    p = [0.2, 0.5, 0.7, 0.35, 0.9]
    for seed in range(4000):
        out, at = mixing.pivot([1, 2, 3, 4, 5], p, seed)
        if at >= 0:
            out[at] = 1.0 if mixing._uniform(at, 0, seed + 10**6) < out[at] else 0.0
        hits += out
    assert np.abs(hits / 4000 - p).max() < 0.03


def test_takes():
    targets = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 3), ("none", 0.1, 5)]
    takes = mixing.plan_takes({"a": 100, "b": 90, "c": 10}, targets)
    sizes = {s: takes[s] * n for s, n in (("a", 100), ("b", 90), ("c", 10))}
    assert takes["c"] == 3 and math.isclose(sizes["a"] / sum(sizes.values()), 0.5) and math.isclose(sizes["b"] / sum(sizes.values()), 0.3)
    held = mixing.plan_takes({"a": 100, "b": 90, "c": 10}, targets, 1000)
    assert held == {"a": 2.0, "b": 1.0, "c": 3.0}
    assert mixing.plan_takes({}, targets) == {} and mixing.plan_takes({"a": 5}, [("a", None, 2), ("b", 1.0, 0)]) == {}


@pytest.mark.parametrize("skew", [False, True])
def test_mix_meets_shares_and_caps(spark, skew):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        s = "big" if skew and rng.random() < 0.5 else rng.choice(["big", "Mid-Size", "mid_size ", "small", "unwanted", None])
        rows.append((i, s, rng.choice([0, 5, 20, 21, 300])))
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").select("doc_id", mixing.source_key(F.col("source")).alias("source"), "n_tokens").repartition(5, "doc_id")
    targets = spark.createDataFrame([("big", 0.3, 1), ("MID_SIZE", 0.4, 2), ("small", 0.3, 3), ("lacking", 0.0, 4)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(None, targets, records=sized)
    got = mix.collect()
    caps = {"big": 1, "mid_size": 2, "small": 3}
    assert len({r["doc_id"] for r in got}) == len(got) and all(0 < r["copies"] <= caps[r["source"]] and r["n_tokens"] > 0 for r in got)
    total = sum(r["copies"] * r["n_tokens"] for r in got)
    for s, w in (("big", 0.3), ("mid_size", 0.4), ("small", 0.3)):
        mine = sum(r["copies"] * r["n_tokens"] for r in got if r["source"] == s)
        assert abs(mine - w * total) <= 3 * 300, (s, mine, w * total)
    for parts, per_bucket in ((5, mixing.BUCKET), (7, mixing.BUCKET), (3, 100)):
        # the same mix however the data are partitioned; shares also hold with small buckets
        mixing_bucket, mixing.BUCKET = mixing.BUCKET, per_bucket
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            again = {(r["doc_id"], r["copies"]) for r in mixing.mix_sources(None, targets, records=sized.repartition(parts)).collect()}
        finally:
            mixing.BUCKET = mixing_bucket
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        if per_bucket == mixing.BUCKET:
            assert again == {(r["doc_id"], r["copies"]) for r in got}
        else:
            size = {r["doc_id"]: r["n_tokens"] for r in sized.collect()}
            assert abs(sum(k * size[d] for d, k in again) - sum(r["copies"] * r["n_tokens"] for r in got)) <= 3 * 3 * 300
    shares = {r["source"]: r for r in mixing.report_shares(mix, targets).collect()}
    assert set(shares) == {*caps, "lacking"} and math.isclose(sum(r["actual_share"] for r in shares.values()), 1.0) and shares["lacking"]["tokens"] == 0


@needs_vocabulary
def test_mix_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, " S-x", "some words here"), (2, None, "a"), (None, "s_x", "a"), (3, "s_x", None), (4, "s x", ""), (1, "S_X", "again")], DOCS).withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("s_x", 1.0, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    assert sorted((r["doc_id"], r["n_tokens"], r["copies"]) for r in mixing.mix_sources(docs, targets).collect()) == [(1, 1, 1), (1, 3, 1)]
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0 and mixing.mix_sources(docs, targets.limit(0)).count() == 0


BASIC = "the cat sees the dog and the dog sees the {} in the house"
HARD = "the {} jurisprudence presupposes, notwithstanding the dialectical heterogeneity of the {} axiom, the counterfactual proportionality of the norm"


def suffix(i, k):
    x = i * 37 + k * 11 + 5
    return "".join("bcdfghklmn"[x // 10**j % 10] + "aeiou"[x // 10**j % 5] for j in range(4))


def prose(level, i, n=6):
    noun = ["cat", "ball", "tree", "boat", "star"]
    if level == "basic":
        return " ".join(f"{BASIC.format(noun[(i + k) % 5] + suffix(i, k))}.".capitalize() for k in range(n))
    if level == "middle":
        return " ".join(f"The council repairs the market {noun[(i + k) % 5]} because the visitors of the museum describe the {noun[k % 5]}{suffix(i, k)} of the season." for k in range(n))
    return " ".join(HARD.format(noun[(i + k) % 5] + suffix(i, k), noun[k % 5]).capitalize() + "." for k in range(n))


PASSAGES = "passage_id long, lang string, level string, text string"


def corpus():
    docs, want = [], {}
    for i in range(90):
        level = reading_level.LEVELS[i % 3]
        docs.append((i, "s", f"Home | News | Search\nThis site keeps cookies on your device number {i}. OK\n\n{prose(level, i)}\n\nPrivacy policy"))
        want[i] = level
    docs += [(100 + i, "s", "Home | News\nThis site keeps cookies on your device number 7. OK\nSorry, the page is gone for good.") for i in range(20)]
    docs += [(200, "s", None), (201, "s", ""), (202, "s", " \n "), (203, "s", "for (i = 0; i < n; i++) { x[i] = y; }"), (204, "s", "русский текст. 日本語の文章。" * 5), (205, "s", "\n".join(f"the house 12,5{i}" for i in range(40)))]
    return docs, want


def test_levels_of_a_small_corpus(spark):
    docs, want = corpus()
    passages = [(3 * i + k, "en", lv, prose(lv, 50 + i, 4)) for i in range(12) for k, lv in enumerate(reading_level.LEVELS)] + [(99, None, "basic", "x"), (98, "en", None, None)]
    df = spark.createDataFrame(docs, DOCS).withColumn("level", F.lit("clash")).withColumn("x", F.lit(1)).withColumn("lang", F.lit("de"))
    args = (spark.createDataFrame(passages, PASSAGES),)
    levels = reading_level.reading_levels(df, *args)
    assert levels.count() == len(docs)
    got = {r["doc_id"]: r["level"] for r in reading_level.level_found(levels).collect()}
    assert set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)
    why = {r["doc_id"]: r["reason"] for r in levels.collect()}
    assert all(why[k] is None for k in want) and {why[k] for k in why if k not in want} == {"short"}
    # ranks that the head of the vocabulary does not reach are found exactly
    cols = ["doc_id", "lang", "n_words", "rank_60", "rank_70", "rank_80", "rank_90", "level"]
    whole = {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in levels.select(cols).collect()}
    short = {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in reading_level.reading_levels(df, *args, head=10).select(cols).collect()}
    assert whole == short


def test_a_page_mirrored_over_a_third_of_the_rows_keeps_its_level(spark):
    docs, want = corpus()
    lines = prose("advanced", 500).split(". ")
    for i in range(60):
        # whole, slightly changed, and in other surroundings
        text = ". ".join(lines if i % 3 else [*lines[: i % 5], f"The {suffix(i, 70)} of the copy is {suffix(i, 71)} here", *lines[i % 5 + 1 :]])
        docs.append((1000 + i, "s", text if i % 2 else f"Home | News\nThis site keeps cookies on your device number {i}. OK\n\n{text}"))
        want[1000 + i] = "advanced"
    passages = [(3 * i + k, "en", lv, prose(lv, 50 + i, 4)) for i in range(12) for k, lv in enumerate(reading_level.LEVELS)]
    levels = reading_level.reading_levels(spark.createDataFrame(docs, DOCS), spark.createDataFrame(passages, PASSAGES))
    words = {r["doc_id"]: r["n_words"] for r in levels.collect()}
    assert len({words[k] for k in want if k >= 1000 and k % 3 != 1}) == 1  # all of the page, without notices
    got = {r["doc_id"]: r["level"] for r in reading_level.level_found(levels).collect()}
    assert set(got) == set(want)
    assert all(got[k] == "advanced" for k in want if k >= 1000)


def test_common_sentences_are_marked_by_a_join_too(spark, monkeypatch):
    docs, _ = corpus()
    passages = spark.createDataFrame([(3 * i + k, "en", lv, prose(lv, 50 + i, 4)) for i in range(12) for k, lv in enumerate(reading_level.LEVELS)], PASSAGES)
    df = spark.createDataFrame(docs, DOCS)
    cols = ["doc_id", "n_words", "level", "reason"]
    told = {tuple(r) for r in reading_level.reading_levels(df, passages).select(cols).collect()}
    monkeypatch.setattr(reading_level, "BROADCAST", 0)
    assert {tuple(r) for r in reading_level.reading_levels(df, passages).select(cols).collect()} == told


def test_what_is_around_the_content_hangs_on_the_site_not_on_the_corpus(spark):
    docs, want = corpus()
    passages = spark.createDataFrame([(3 * i + k, "en", lv, prose(lv, 50 + i, 4)) for i in range(12) for k, lv in enumerate(reading_level.LEVELS)], PASSAGES)
    urls = [(i, f"https://small.example/{i}", t) for i, _, t in docs]
    more = urls + [(10_000 + i, f"http://Other{i % 50}.example:80/x", f"{prose('middle', 1000 + i)} So said visitor {suffix(i, 9)} of the town.") for i in range(1500)]
    schema = "doc_id long, url string, text string"
    few, many = ({r["doc_id"]: (r["n_words"], r["reason"]) for r in reading_level.reading_levels(spark.createDataFrame(x, schema), passages).collect()} for x in (urls, more))
    assert all(many[k] == v for k, v in few.items())


def test_the_coverage_rank_decides(spark, monkeypatch):
    # two levels whose sentences are alike, and only the frequency of the words differs
    rng = random.Random(6)
    usual, rare = [suffix(i, 1) for i in range(30)], [suffix(i, 2) for i in range(3000)]

    def text(level, n=5):
        pick = lambda: rng.choice(usual) if level == "basic" or rng.random() < 0.3 else rng.choice(rare)
        return " ".join(f"The {pick()} sees {pick()} and {pick()} near the {pick()} of {pick()} {pick()}." for _ in range(n))

    levels = ("basic", "advanced")
    docs = spark.createDataFrame([(i, "s", text(levels[i % 2])) for i in range(400)], DOCS)
    passages = spark.createDataFrame([(i, "en", levels[i % 2], text(levels[i % 2])) for i in range(40)], PASSAGES)
    right = lambda: sum(r["level"] == levels[r["doc_id"] % 2] for r in reading_level.reading_levels(docs, passages).collect())
    assert right() >= 392
    monkeypatch.setattr(reading_level, "word_ranks", lambda words: words.select("lang", "h", F.lit(1).cast("long").alias("rank")))
    assert right() < 300


def test_a_language_without_passages_has_a_reason(spark):
    docs, want = corpus()
    passages = [(3 * i + k, "en", lv, prose(lv, 50 + i, 4)) for i in range(12) for k, lv in enumerate(reading_level.LEVELS)] + [(200 + i, "xx", "basic", "rok mek tulo vasa pindu gorra lemi satu.") for i in range(2)]
    docs = [*docs, (900, "s", "zzor pluk gnar wibble frotz xyzzy plugh. " * 6), (901, "s", "rok mek tulo vasa. pindu gorra lemi satu mek tulo. " * 5)]
    got = {r["doc_id"]: (r["level"], r["reason"]) for r in reading_level.reading_levels(spark.createDataFrame(docs, DOCS), spark.createDataFrame(passages, PASSAGES)).collect()}
    assert got[900] == (None, "language") and got[901] == (None, "passages") and got[205] == (None, "short")


def test_coverage_rank_against_a_plain_version():
    rng = random.Random(5)
    docs = [[rng.randint(1, 40) for _ in range(rng.randint(0, 30))] for _ in range(200)]
    doc = np.array([d for d, ranks in enumerate(docs) for _ in ranks])
    got = reading_level.coverage_ranks(doc, np.array([r for ranks in docs for r in ranks]), len(docs), (0.5, 0.8, 0.95))
    for ranks, row in zip(docs, got):
        for q, x in zip((0.5, 0.8, 0.95), row):
            if ranks:
                assert x == min(r for r in ranks if sum(k <= r for k in ranks) >= math.ceil(q * len(ranks)))
            else:
                assert x != x


def test_ranks_let_ties_enter_together(spark):
    counts = spark.createDataFrame([("en", i, n) for i, n in enumerate([9, 5, 5, 2, 1, 1, 1])], "lang string, h long, n long")
    assert {r["h"]: r["rank"] for r in reading_level.word_ranks(counts).collect()} == {0: 1, 1: 3, 2: 3, 3: 4, 4: 7, 5: 7, 6: 7}


def test_no_documents_and_no_passages(spark):
    docs, _ = corpus()
    none = spark.createDataFrame([], PASSAGES)
    assert reading_level.reading_levels(spark.createDataFrame([], DOCS), none).count() == 0
    levels = reading_level.reading_levels(spark.createDataFrame(docs, DOCS), none)
    assert levels.count() == len(docs) and reading_level.level_found(levels).count() == 0
