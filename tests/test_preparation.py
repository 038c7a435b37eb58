"""The core's data-preparation operators against plain versions, and on awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import implausible, regular_grid, rolling
from seriesloom.operators.responses import canonical_name

RESP = "fetch_id long, name string, path_expr string, start long, stop long, step long, vals array<double>, cons_func string, xff double, fetched_at timestamp"
SERIES = "sid long, name string, start long, stop long"
DAY = 86400


def responses(spark, rows):
    """(name, start, stop, step, vals)"""
    full = [(i + 1, n, None, a, b, s, v, None, None, None) for i, (n, a, b, s, v) in enumerate(rows)]
    return spark.createDataFrame(full, RESP)


@pytest.mark.parametrize(
    "raw, want",
    [("a.b", "a.b"), (" a.b\t", "a.b"), (".a..b.", "a.b"), ("a.b;y=2;x=1", "a.b;x=1;y=2"), ("a.b.;x=1; y=2 ;", "a.b;x=1;y=2"), ("a.b;x-a=1;x=2", "a.b;x=2;x-a=1"), ("", ""), (None, None), ("A.b", "A.b"), ("a;x=1;x=1", "a;x=1"),
     ("a;x1=1;x=1", "a;x=1;x1=1"), ("a;x=1;x1=1", "a;x=1;x1=1"), ("a;x=b=c;x=b", "a;x=b;x=b=c"), ("a;b;a", "a;a;b"), ("a.b;v=1..2", "a.b;v=1..2"), (";x=1", ";x=1"), ("a;", "a"), ("a. b", "a.b"), ("\na.b;k=1\r", "a.b;k=1")],
)
def test_one_spelling(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(canonical_name("n")).first()[0] == want


def test_two_stack_queue_is_a_sliding_window():
    rng = random.Random(3)
    for combine, plain in ((max, max), (lambda a, b: a + b, sum)):
        q = rolling.TwoStackQueue(combine)
        live, key = [], 0
        for _ in range(2000):
            key += rng.randint(0, 3)
            x = rng.randint(-50, 50)
            q.push(key, x)
            live.append((key, x))
            low = key - rng.randint(0, 20)
            q.evict_before(low)
            live = [kx for kx in live if kx[0] >= low]
            assert q.total() == (plain([x for _, x in live]) if live else None)


def brute_rolling(rows, series, p):
    slots = {}
    for name, a, b, s, vals in rows:
        for i, v in enumerate(vals or []):
            t = a + i * s
            if v is not None and v == v and t < b:
                k = (name, t - t % s)
                slots[k] = max(v, slots.get(k, -1e300))
    out = {}
    for sid, name, a, b in series:
        for d in range(a // DAY, -(-b // DAY)):
            vs = [v for (n, t), v in slots.items() if n == name and d - p < t // DAY <= d]
            out[sid, d] = (round(sum(vs), 6), len(vs), min(vs) if vs else None)
    return out


def test_rolling_totals_against_a_plain_version(spark):
    rng = random.Random(1)
    series = [(1, "a", 0, 70 * DAY), (2, "b", 10 * DAY, 15 * DAY), (3, "c", 5 * DAY, 5 * DAY)]
    rows = []
    for _ in range(120):
        n, d, k = rng.choice("aab"), rng.randint(0, 69), rng.choice([21600, 43200])
        vals = [rng.choice([None, float("nan"), 0.0, 1.5, -2.0]) for _ in range(rng.randint(0, 9))]
        rows.append((n, d * DAY + rng.choice([0, 0, 77]), (d + 1) * DAY, 21600, vals))
    rows += rows[:20]
    got = rolling.rolling_totals(responses(spark, rows), spark.createDataFrame(series, SERIES), (7, 30), block_days=32).collect()
    for p in (7, 30):
        want = brute_rolling(rows, series, p)
        mine = {(r["sid"], r["day"].toordinal() - 719163): (round(r[f"total_{p}"], 6), r[f"n_{p}"], r[f"min_{p}"]) for r in got}
        assert mine == want


def test_rolling_awkward_rows(spark):
    rows = [(None, 0, DAY, 60, [1.0]), ("x", None, DAY, 60, [1.0]), ("x", 0, DAY, 0, [1.0]), ("x", 0, DAY, 60, None), ("x", 0, DAY, 60, []), ("unknown", 0, DAY, 60, [1.0]), ("x", 0, None, 60, [1.0])]
    series = spark.createDataFrame([(1, "x", 0, DAY), (2, None, 0, DAY), (3, "y", None, DAY), (None, "z", 0, DAY)], SERIES)
    got = rolling.rolling_totals(responses(spark, rows), series).collect()
    assert sorted((r["sid"], r["active"], r["total_7"], r["avg_7"]) for r in got) == [(1, False, 0.0, None), (2, False, 0.0, None)]
    empty = rolling.rolling_totals(responses(spark, []), spark.createDataFrame([], SERIES))
    assert empty.count() == 0
    found = rolling.inactive_days(rolling.rolling_totals(responses(spark, rows).withColumn("sid", F.lit("clash")).withColumn("day", F.lit(1)), series))
    assert sorted(map(tuple, found.collect())) == [(1, "1970-01-01"), (2, "1970-01-01")]
    with pytest.raises(ValueError):
        rolling.rolling_totals(responses(spark, []), series, (0,))


READ, TARGET = "target_id long, ts double, v double, received_at timestamp", "target_id long, step long"


def brute_grid(rows, steps, limit):
    out = {}
    for target, step in steps.items():
        pts = {}
        for t, ts, v in rows:
            if t != target or v is None or v != v or ts is None or ts != ts or ts <= 0:
                continue
            pts.setdefault(ts / 1000 if ts >= 1e11 else ts, set()).add(v)
        slots = {}
        for ts, vs in pts.items():
            slots.setdefault(int(ts // step), []).append((ts, vs))
        keys = sorted(slots)
        for a, b in zip(keys, keys[1:] + [None]):
            every = [v for _, vs in slots[a] for v in vs]
            out[target, a * step] = ("observed", round(sum(every) / len(every), 6))
            if b is None:
                continue
            t0, v0 = max(slots[a])
            t1, v1 = min(slots[b])
            v0, v1 = sum(v0) / len(v0), sum(v1) / len(v1)
            for k in range(a + 1, b):
                near = t1 - t0 <= limit * step
                out[target, k * step] = ("interpolated", round(v0 + (v1 - v0) * ((k + 0.5) * step - t0) / (t1 - t0), 6)) if near else ("gap", None)
    return out


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_grid_against_a_plain_version(spark, block):
    rng = random.Random(block)
    base, rows = 1_710_000_000, []
    for target in (1, 1, 1, 2):
        t = base + rng.random() * 100
        for _ in range(120):
            t += rng.choice([3, 8, 10, 11, 25, 90, 700])
            rows.append((target, t * (1000 if rng.random() < 0.1 else 1), rng.choice([None, float("nan"), 1.0, 2.0, rng.random()])))
    rows += rows[::7] + [(1, None, 5.0), (1, 0.0, 5.0), (2, float("nan"), 1.0), (3, float(base), None), (9, float(base), 1.0), (None, float(base), 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, None) for r in rows], READ).withColumn("step", F.lit("clash")).withColumn("slot", F.lit(0))
    got = regular_grid.regular_grid(df, spark.createDataFrame([(1, 10), (2, 20), (3, 5), (4, None)], TARGET), max_gap_periods=10, block_periods=block).collect()
    mine = {(r["target_id"], r["slot_ts"]): (r["how"], None if r["v"] is None else round(r["v"], 6)) for r in got}
    assert len(mine) == len(got)
    want = brute_grid(rows, {1: 10, 2: 20, 3: 5}, 10)
    assert set(mine) == set(want)
    for k, (how, v) in want.items():
        assert mine[k][0] == how and (v is None) == (mine[k][1] is None) and (v is None or abs(v - mine[k][1]) < 1e-5), k


def test_grid_of_nothing(spark):
    grid = regular_grid.regular_grid(spark.createDataFrame([], READ), spark.createDataFrame([], TARGET))
    assert grid.count() == 0 and regular_grid.empty_periods(grid).count() == 0


def day_course(n, per_day, rng, noise=0.5):
    i = np.arange(n)
    return 50 + 10 * np.sin(2 * np.pi * i / per_day) + rng.normal(0, noise, n)


def flagged(spark, name, x, step=1800, start=1_710_028_800, **more):
    vals = [None if v != v else float(v) for v in x]
    df = responses(spark, [(name, start, start + len(vals) * step, step, vals)])
    return {(r["ts"] - start) // step: set(r["reasons"]) for r in implausible.implausible_values(df, **more).collect()}


def test_spikes_stuck_and_impossible_values_are_found(spark):
    rng = np.random.default_rng(5)
    x = day_course(48 * 30, 48, rng)
    x[500:502] += 30
    x[900] -= 25
    x[1000:1020] = x[1000]
    x[1200] = -5
    x[300:310] = np.nan
    got = flagged(spark, "a.b.cpu.user_pct", x)
    assert set(got) == {500, 501, 900, 1200, *range(1000, 1020)}
    assert got[1200] == {"impossible"} and got[500] == {"spike"} and got[1000] == {"stuck"}


def test_spikes_beside_gaps_and_at_the_ends_are_found(spark):
    rng = np.random.default_rng(9)
    n = 48 * 30
    x = day_course(n, 48, rng)
    x[500:596] = np.nan
    x[601:700] = np.nan
    for k in (0, 499, 600, 700, 900, n - 1):
        x[k] += 60
    x[[899, 901, 902]] = np.nan
    want = {0, 499, 600, 700, 900, n - 1}
    assert flagged(spark, "a.b.room.temp_celsius", x) == {k: {"spike"} for k in want}
    # levels that differ across a gap, and a shift shortly before the end, are no spikes
    y = day_course(n, 48, rng)
    y[500:900] = np.nan
    y[900:] += 40
    y[n - 2 :] += 40
    assert flagged(spark, "a.b.room.temp_celsius", y) == {}


def test_usual_behaviour_is_not_flagged(spark):
    rng = np.random.default_rng(6)
    n, per = 48 * 30, 48
    shift = day_course(n, per, rng)
    shift[700:] += 40  # a lasting shift
    assert flagged(spark, "a.b.room.temp_celsius", shift) == {}
    peaks = day_course(n, per, rng)
    peaks[20::per] += 40  # the same time every day
    assert flagged(spark, "a.b.requests.count", peaks) == {}
    counter = np.cumsum(rng.integers(50, 100, n)).astype(float)
    counter[800:] -= counter[800]  # a reset
    assert flagged(spark, "a.b.uptime.ticks", counter) == {}
    level = np.full(n, 1024.0)
    level[600:] = 2048.0
    assert flagged(spark, "a.b.limit.max_open", level) == {}
    bursts = np.exp(rng.normal(0, 0.5, n)) * 1e6
    bursts[rng.integers(0, n, 30)] *= 10
    assert flagged(spark, "a.b.net.rx_bytes", bursts) == {}


def test_every_delivery_is_flagged(spark):
    rng = np.random.default_rng(7)
    x = day_course(48 * 20, 48, rng)
    x[400] += 40
    vals, start = x.tolist(), 1_710_028_800
    one = ("s.cpu.user_pct", start, start + len(vals) * 1800, 1800, vals)
    off = (" s..cpu.user_pct", start + 399 * 1800 + 60, start + 402 * 1800, 1800, vals[399:403])
    got = implausible.implausible_found(implausible.implausible_values(responses(spark, [one, one, off]))).collect()
    assert sorted(map(tuple, got)) == [(1, start + 400 * 1800), (2, start + 400 * 1800), (3, start + 400 * 1800 + 60)]


def test_chunks_do_not_change_what_is_found(spark):
    rng = np.random.default_rng(8)
    start, rows = 1_710_028_800, []
    for k, name in enumerate(("s.cpu.user_pct", "s.net.rx_bytes", "s.queue.depth")):
        n = 48 * 60
        x = (day_course(n, 48, rng), np.exp(rng.normal(0, 0.5, n)) * 1e6, rng.poisson(1.0, n).astype(float))[k]
        x[30::48] += x.std() * 8  # the same time every day
        for at in (10, 999, 1000, 1001, 1500, 2400):
            x[at] = x[at] * 3 + 60
        x[1990:2015] = x[1990]
        x[600:700] = np.nan
        x[1700] = -1
        rows.append((name, start, start + n * 1800, 1800, [None if v != v else float(v) for v in x]))
    rows.append(("one", start, start + 1800, 1800, [1.0]))
    x = rng.normal(0, 1, n)  # nothing is ever repeated
    x[1234] = 90.0
    rows.append(("never.the.same", start, start + n * 1800, 1800, x.tolist()))
    df = responses(spark, rows)
    whole = {tuple(r) for r in implausible.implausible_slots(df).collect()}
    cut = {tuple(r) for r in implausible.implausible_slots(df, chunk_slots=1000, halo_slots=200).collect()}
    assert whole == cut and len(whole) >= 3 * (6 + 25 + 1) - 2


def test_the_wavelets_decide(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = day_course(48 * 30, 48, rng)
    x[500:502] += 30
    x[1000:1020] = x[1000]
    x[1200] = -5
    assert {r for v in flagged_here(x).values() for r in v} == {"spike", "stuck", "impossible"}
    with monkeypatch.context() as m:  # without detail there is no spike
        m.setattr(implausible, "median_filter", lambda y, w: y)
        assert {r for v in flagged_here(x).values() for r in v} == {"stuck", "impossible"}
    with monkeypatch.context() as m:  # where all is detail nothing is stuck
        m.setattr(implausible, "haar_details", lambda y: np.ones(len(y) - 1))
        assert {r for v in flagged_here(x).values() for r in v} == {"spike", "impossible"}


def flagged_here(x, step=1800):
    """judge() without Spark: reasons by place."""
    seen = np.flatnonzero(~np.isnan(x))
    out = {}
    for reason, slots in implausible.judge(implausible.Chunk(seen, x[seen], np.ones(len(seen), bool), step, 0.0, 100.0)).items():
        for s in slots:
            out.setdefault(int(s), set()).add(reason)
    return out


def test_median_filter_and_classes():
    rng = np.random.default_rng(3)
    for w in implausible.WIDTHS:
        for n in (1, 2, 3, 6, 50):
            y = rng.integers(0, 9, n).astype(float)
            rows = np.lib.stride_tricks.sliding_window_view(np.pad(y, w // 2, mode="symmetric"), w)
            assert (implausible.median_filter(y, w) == np.median(rows, axis=1)).all()
    x = np.concatenate([rng.normal(0, 1, 200) * 10.0 ** rng.integers(-12, 18, 200), [0.0]])
    c = implausible.classes(x)
    inner = x != 0
    assert (np.abs(implausible.size_of(c)[inner] / x[inner] - 1) < 0.023).all() and implausible.size_of(c)[-1] == 0
    assert (np.diff(implausible.classes(np.sort(np.abs(x)))) >= 0).all()
    keys, n = np.unique(c, return_counts=True)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert implausible.quantile(keys, n, q) == implausible.quantile(c, None, q)


def test_a_twentieth_of_spikes_does_not_hide_them():
    rng = np.random.default_rng(4)
    x = rng.normal(50, 1, 2000)
    at = np.arange(10, 2000, 20)
    x[at] += rng.choice([-30, 30], len(at))
    got = {k for k, v in flagged_here(x, step=7000).items() if "spike" in v}  # a step that divides no day
    assert got == set(at.tolist())


def test_implausible_awkward_rows(spark):
    rows = [(None, 0, DAY, 60, [1.0]), ("x", None, DAY, 60, [1.0]), ("x", 0, DAY, -5, [1.0]), ("x", 0, DAY, 60, None), ("x", 0, DAY, 60, []), ("x", 0, DAY, 60, [None, float("nan")]), ("y", 0, DAY, 60, [float("inf"), 1.0]), ("z.used_pct", 0, 120, 60, [50.0, 150.0, 999.0])]
    got = implausible.implausible_values(responses(spark, rows).withColumn("chunk", F.lit("clash")).withColumn("slot", F.lit(1))).collect()
    assert sorted((r["fetch_id"], r["ts"]) for r in got) == [(7, 0), (8, 60)]
    assert implausible.implausible_values(responses(spark, [])).count() == 0
