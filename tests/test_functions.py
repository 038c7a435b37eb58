"""Cases with known numbers: request, series, expected values."""

import math

import pytest

from seriesloom.functions.registry import REGISTRY, EvalError
from seriesloom.plans.engine import Engine
from seriesloom.sources.base import MemorySource

N = None


def S(name, values, step=1, start=0, **more):
    return {"name": name, "values": values, "step": step, "start": start, **more}


def run(spark, target, rows, start=0, until=None, **options):
    until = until if until is not None else max(r["start"] + len(r["values"]) * r["step"] for r in rows)
    frame = Engine(spark, MemorySource(spark, rows), **options).frame(target, start, until, now=until)
    out = {}
    for r in frame.result().orderBy("ord", "ts").collect():
        out.setdefault(r["name"], []).append((r["ts"], r["value"]))
    return out


def check(got, want):
    assert list(got) == list(want), (list(got), list(want))
    for name, values in want.items():
        mine = [v for _, v in got[name]]
        assert len(mine) == len(values), (name, mine)
        for a, b in zip(mine, values):
            assert (a is None) == (b is None), (name, mine, values)
            assert a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6), (name, mine, values)


FIVE = [1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 1, 2, 3, 4, N, N, N, N, N, N]

CASES = [
    ("summarize(metric1,'5s')", [S("metric1", FIVE)], {"summarize(metric1,'5s')": [5, 10, 15, 20, 25, 10, N, N]}),
    ("summarize(metric1,'5s','last')", [S("metric1", FIVE)], {"summarize(metric1,'5s','last')": [1, 2, 3, 4, 5, 4, N, N]}),
    ("summarize(metric1,'5s','p50')", [S("metric1", FIVE)], {"summarize(metric1,'5s','p50')": [1, 2, 3, 4, 5, 2.5, N, N]}),
    ("summarize(metric1,'5s')", [S("metric1", [1, 2, 3], 10)], {"summarize(metric1,'5s')": [1, N, 2, N, 3, N, N]}),
    ("ewma(metric1,0.9)", [S("metric1", [0, 1, 1, 1, N, 1, 1])], {"ewma(metric1,0.9)": [0, 0.9, 0.99, 0.999, N, 0.9999, 0.99999]}),
    ("interpolate(metric1)", [S("metric1", [1, 2, 3, 4, N, N, N, 6, 7, 8])], {"interpolate(metric1)": [1, 2, 3, 4, 4.5, 5, 5.5, 6, 7, 8]}),
    ("interpolate(metric1,2)", [S("metric1", [N, 1, N, 3, N, N, N, 7, N])], {"interpolate(metric1,2)": [N, 1, 2, 3, N, N, N, 7, N]}),
    ("nonNegativeDerivative(metric1,32)", [S("metric1", [2, 4, 0, 10, 1, N, 8, 40, 37])], {"nonNegativeDerivative(metric1,32)": [N, 2, 29, 10, 24, N, N, 32, N]}),
    ("keepLastValue(metric1,2)", [S("metric1", [1, N, N, N, 5, N])], {"keepLastValue(metric1,2)": [1, 1, 1, N, 5, 5]}),
    ("derivative(metric1)", [S("metric1", [2, 4, N, 10, 1])], {"derivative(metric1)": [N, 2, N, 6, -9]}),
    ("changed(metric1)", [S("metric1", [1, 1, N, 1, 2, 2])], {"changed(metric1)": [0, 0, 0, 0, 1, 0]}),
    ("movingMedian(metric1,4)", [S("metric1", [1, 1, 1, 1, 2, 2, 2, 4, 6, 4, 6, 8])], {"movingMedian(metric1,4)": [N, N, N, 1, 1, 1.5, 2, 2, 3, 4, 5, 6]}),
    ("delay(metric1,-2)", [S("metric1", [1, 2, 3, 4])], {"delay(metric1,-2)": [3, 4, N, N]}),
    ("removeBelowValue(metric1,2)", [S("metric1", [1, 2, N, 3])], {"removeBelowValue(metric1,2)": [N, 2, N, 3]}),
    ("slo(metric1,'10sec','above',2)", [S("metric1", [1, 2, 3, 4, 5, N, N, 6, 7, 0, 8], 5)], {"slo(metric1,'10sec','above',2)": [0, 1, 1, 1, 0.5, 1]}),
    ("compressPeriodicGaps(metric1)", [S("metric1", [N, 1, N, N, 2, N, N, 3, N, N])], {"compressPeriodicGaps(metric1)": [1, 2, 3]}),
    ("compressPeriodicGaps(metric1)", [S("metric1", [1, 2, 3, N])], {"compressPeriodicGaps(metric1)": [1, 2, 3, N]}),
    ("sum(metric*)", [S("metric1", [1, N, 3]), S("metric2", [2, N, N])], {"sumSeries(metric*)": [3, N, 3]}),
    ("diff(metric*)", [S("metric1", [N, 5, 3]), S("metric2", [2, 1, N])], {"diffSeries(metric*)": [2, 4, 3]}),
    ("multiply(metric*)", [S("metric1", [2, 5, 3]), S("metric2", [2, N, -1])], {"multiplySeries(metric*)": [4, N, -3]}),
    ("first(metric*)", [S("metric1", [N, 5]), S("metric2", [2, 1])], {"firstSeries(metric*)": [N, 5]}),
    ("avg_zero(metric*)", [S("metric1", [N, 4]), S("metric2", [2, 2])], {"avg_zeroSeries(metric*)": [1, 3]}),
    ("percentileOfSeries(metric*,50)", [S("metric1", [1, 4]), S("metric2", [2, 5]), S("metric3", [3, 6]), S("metric4", [9, N])], {"percentileOfSeries(metric*,50)": [3, 5]}),
    ("percentileOfSeries(metric*,50,true)", [S("metric1", [1, 4]), S("metric2", [2, 5]), S("metric3", [3, 6]), S("metric4", [9, N])], {"percentileOfSeries(metric*,50)": [2.5, 5]}),
    ("sortByName(metric*,true)", [S(n, [1]) for n in ("metric10", "metric2", "metric1")], {n: [1] for n in ("metric1", "metric2", "metric10")}),
    ("groupByNode(a.*.*,2,'sum')", [S("a.x.p", [1, 2]), S("a.x.q", [3, 4]), S("a.y.p", [5, N])], {"p": [6, 2], "q": [3, 4]}),
    ("asPercent(metric*,10)", [S("metric1", [1, N]), S("metric2", [5, 0])], {"asPercent(metric1,10)": [10, N], "asPercent(metric2,10)": [50, 0]}),
    ("divideSeries(metric1,metric2)", [S("metric1", [1, 2, N]), S("metric2", [2, 0, 1])], {"divideSeries(metric1,metric2)": [0.5, N, N]}),
    ("powSeries(metric*)", [S("metric1", [2, 3, 0]), S("metric2", [3, N, -1])], {"powSeries(metric*)": [8, N, N]}),
    ("reduceSeries(mapSeries(a.*.*,1),'asPercent',2,'v','t')", [S("a.s1.v", [2]), S("a.s1.t", [8]), S("a.s2.v", [1])], {"a.s1.reduce.asPercent": [25]}),
    ("aliasByNode(scale(a.b.c,2),1)", [S("a.b.c", [1])], {"b": [2]}),
    ("substr(a.b.c.d,1,3)", [S("a.b.c.d", [1])], {"b.c": [1]}),
    ("log(metric1)", [S("metric1", [1, 10, 0, -1, N])], {"logarithm(metric1)": [0, 1, float("-inf"), N, N]}),
    ("round(metric1)", [S("metric1", [0.5, 1.5, 2.5, -0.5])], {"round(metric1)": [0, 2, 2, 0]}),
    ("lowPass(metric1,40)", [S("metric1", list(range(10)))], {"lowPass(metric1,40)": [0, 1, N, N, N, N, N, N, 8, 9]}),
    ("stdev(metric1,3,0.1)", [S("metric1", [1, 2, 4, N, 4])], {"stdev(metric1,3)": [0, 0.5, 1.2472191289246, N, 0]}),
    ("countValues(metric*)", [S("metric1", [1, 2]), S("metric2", [1, N])], {"1": [2, 0], "2": [0, 1]}),
    ("hitcount(metric1,'20s')", [S("metric1", [1, 2, N, 4], 10)], {"hitcount(metric1,'20s')": [30, 40]}),
    ("hitcount(metric1,'15s')", [S("metric1", [1, 1, 1], 10)], {"hitcount(metric1,'15s')": [15, 15]}),
    ("integralByInterval(metric1,'2s')", [S("metric1", [1, N, 3, 4, 5])], {"integralByInterval(metric1,'2s')": [1, 1, 3, 7, 5]}),
    ("weightedAverage(a.*.v,a.*.w,1)", [S("a.x.v", [1, 2]), S("a.x.w", [1, N]), S("a.y.v", [4, 4]), S("a.y.w", [3, 1])], {"weightedAverage(a.*.v,a.*.w,1)": [3.25, 4]}),
    ("limit(metric*,-1)", [S("metric1", [1])], {}),
    ("polyfit(metric1,2)", [S("metric1", [0, 1, 4, 9, N, 25])], {"polyfit(metric1,2)": [0, 1, 4, 9, 16, 25]}),
    ("linearRegression(metric1)", [S("metric1", [1, N, N, N])], {"linearRegression(metric1)": [N, N, N, N]}),
    ("transformNull(metric1,7,referenceSeries=metric2)", [S("metric1", [1, N, N]), S("metric2", [N, 3, N])], {"transformNull(metric1,7)": [1, 7, N]}),
    ("fallbackSeries(none,metric1)", [S("metric1", [1])], {"metric1": [1]}),
    ("tukeyAbove(metric*,1.5,1)", [S("metric1", [1, 2, 3, 2, 3, 1]), S("metric2", [1, 50, 2, 3, 2, 2])], {"metric2": [1, 50, 2, 3, 2, 2]}),
]


@pytest.mark.parametrize("target, rows, want", CASES, ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_cases(spark, target, rows, want):
    check(run(spark, target, rows), want)


def test_exponential_moving_average(spark):
    rows = [S("m", [2, 4, 6, 8, 12, 14, 16, 18, 20], 10)]
    got = run(spark, "exponentialMovingAverage(m,'30s')", rows, 20, 90)
    # the values read from half a minute before the range seed the average
    assert [ts for ts, _ in got["exponentialMovingAverage(m,'30s')"]] == [20, 30, 40, 50, 60, 70, 80]
    check(got, {"exponentialMovingAverage(m,'30s')": [4, 4.258065, 4.757544, 5.353832, 6.040681, 6.81225, 7.663073]})


def test_look_back_reads_before_the_range(spark):
    rows = [S("m", list(range(20)), 1)]
    check(run(spark, "movingSum(m,3)", rows, 10, 13), {"movingSum(m,3)": [27, 30, 33]})
    check(run(spark, "movingAverage(m,'4s')", rows, 10, 12), {"movingAverage(m,'4s')": [8.5, 9.5]})


@pytest.mark.parametrize("call", ["movingSum(m,{})", "movingAverage(m,{})", "movingMin(m,{})", "movingMax(m,{})", "movingSum(m,{},0.9)", "movingWindow(m,{},'avg_zero')", "movingWindow(m,{},'count')", "movingWindow(m,{},'range')"])
def test_long_windows_agree_with_frames(spark, monkeypatch, call):
    from seriesloom.functions import moving

    # an infinite and a very large value leave no trace once the window has passed them
    rows = [S("m", [None if i % 7 == 3 else 1e17 if i == 20 else math.inf if i == 31 else 0.1 * (i % 11) for i in range(70)], 1)]
    for n in (1, 6, 20):
        want = run(spark, call.format(n), rows, 30, 70)
        with monkeypatch.context() as m:
            m.setattr(moving, "LONG", 0)
            got = run(spark, call.format(n), rows, 30, 70)
        check(got, {k: [v for _, v in x] for k, x in want.items()})


def test_what_leaves_a_window_leaves_no_trace(spark):
    rows = [S("m", [math.inf if i == 300 else 0.1 for i in range(900)], 1), S("n", [1e17 if i == 300 else 0.1 for i in range(900)], 1)]
    for n in (256, 257):
        got = run(spark, f"movingSum({{m,n}},{n})", rows, 880, 900)
        for values in got.values():
            assert all(math.isclose(v, 0.1 * n, rel_tol=1e-9) for _, v in values)


def test_holt_winters_known_value():
    from seriesloom.functions.forecast import holt_winters
    import numpy as np

    n = 7 * 86400 // 600
    p, _ = holt_winters(np.array([float(i % 10) for i in range(n + 10)]), 600, 86400)
    assert math.isclose(p[n], 4.354532587468384, rel_tol=1e-9)


def test_holt_winters_of_several_series_and_gaps():
    import numpy as np

    from seriesloom.functions.forecast import holt_winters

    def plain(x, slots, alpha=0.1, beta=0.0035, gamma=0.1):
        """The recurrences of the docstring, one value at a time, over dictionaries."""
        effect, usual, level, trend, ahead, out = {}, {}, None, 0.0, None, []
        for i, y in enumerate(x):
            p = y if i == 0 else ahead
            if y != y:
                out.append((p, 0.0))
                effect[i], usual[i], level, trend, ahead = 0.0, 0.0, None, 0.0, math.nan
                continue
            old = y if level is None else level
            e, u = effect.get(i - slots, 0.0), usual.get(i - slots, 0.0)
            level = alpha * (y - e) + (1 - alpha) * (old + trend)
            trend = beta * (level - old) + (1 - beta) * trend
            effect[i] = gamma * (y - level) + (1 - gamma) * e
            usual[i] = gamma * abs(y - (0.0 if p is None or p != p else p)) + (1 - gamma) * u
            ahead = level + trend + effect.get(i + 1 - slots, 0.0)
            out.append((p, usual[i]))
        return np.array(out, float).T

    rng = np.random.default_rng(2)
    x = rng.normal(10, 3, (3, 90))
    x[1, 0] = x[1, 40:45] = x[2, 60] = np.nan
    p, d = holt_winters(x, 1, 24)
    for k in range(3):
        want = plain(x[k].tolist(), 24)
        np.testing.assert_allclose(p[k], want[0])
        np.testing.assert_allclose(d[k], want[1])
        np.testing.assert_allclose(holt_winters(x[k], 1, 24)[0], want[0])


def test_matches_are_in_the_order_of_the_pattern(spark):
    rows = [S(n, [1]) for n in ("r.b.x", "r.a.y", "r.c.x", "r.b.y", "r.a.x")]
    assert list(run(spark, "r.{b,a}.*", rows)) == ["r.b.x", "r.b.y", "r.a.x", "r.a.y"]
    assert list(run(spark, "r.*.{y,x}", rows)) == ["r.a.y", "r.a.x", "r.b.y", "r.b.x", "r.c.x"]
    assert list(run(spark, "limit(r.{c,b}.x,1)", rows)) == ["r.c.x"]


def test_reduce_by_any_function_and_from_the_end(spark):
    rows = [S("a.s1.v", [2]), S("a.s1.t", [8]), S("a.s2.v", [1])]
    check(run(spark, "reduceSeries(a.*.*,'asPercent',-1,'v','t')", rows), {"a.s1.reduce.asPercent": [25]})
    check(run(spark, "reduceSeries(a.*.*,'divideSeries',2,'t','v')", rows), {"a.s1.reduce.divideSeries": [4]})
    check(run(spark, "reduceSeries(a.*.*,'squareRoot',2,'v')", [S("a.s1.v", [4]), S("a.s2.v", [9])]), {"a.s1.reduce.squareRoot": [2], "a.s2.reduce.squareRoot": [3]})
    check(run(spark, "reduceSeries(a.*.*,'diffSeries',-1,'t','v')", rows), {"a.s1.reduce.diffSeries": [6]})
    with pytest.raises(EvalError):
        run(spark, "reduceSeries(a.*.*,'asPercent',-4,'v','t')", rows)


def test_one_failing_target_leaves_the_others(spark):
    engine = Engine(spark, MemorySource(spark, [S("m", [1, 2])]))
    got = engine.render(["nosuch(m)", "scale(m,2)", "f("], 0, 2, now=2, tolerant=True).orderBy("ts").collect()
    assert [(r["name"], r["value"]) for r in got] == [("scale(m,2)", 2.0), ("scale(m,2)", 4.0)] and set(engine.failed) == {"nosuch(m)", "f("}
    for targets, tolerant in ((["nosuch(m)", "m"], False), (["nosuch(m)"], True)):
        with pytest.raises(EvalError):
            engine.render(targets, 0, 2, now=2, tolerant=tolerant)
    check(run(spark, "fallbackSeries(nosuch(m),m)", [S("m", [1, 2])]), {"m": [1, 2]})


def test_steps_are_brought_together(spark):
    rows = [S("m1", [1, 2, 3, 4], 1), S("m2", [10, 20], 2)]
    check(run(spark, "sum(m*)", rows), {"sumSeries(m*)": [11.5, 23.5]})
    rows[0]["cons_func"] = "sum"
    check(run(spark, "sum(m*)", rows), {"sumSeries(m*)": [13, 27]})


def test_time_shift(spark):
    rows = [S("m", list(range(10)), 1)]
    got = run(spark, "timeShift(m,'3s')", rows, 5, 8)
    assert list(got.values()) == [[(5, 2.0), (6, 3.0), (7, 4.0)]]


def test_rewrites(spark):
    rows = [S("a.x.v", [1]), S("a.x.w", [2]), S("a.y.v", [5])]
    check(run(spark, "applyByNode(a.*.*,1,'sum(%.*)','%.all')", rows), {"a.x.all": [3], "a.y.all": [5]})
    check(run(spark, "useSeriesAbove(a.*.v,3,'v','w')", rows + [S("a.y.w", [9])]), {"a.y.w": [9]})


def test_empty_lists(spark):
    for target in ("sum(none)", "scale(none,2)", "groupByNode(none,1,'sum')", "sortByTotal(none)", "summarize(none,'5s')", "highest(none,2)", "ewma(none,0.5)", "tukeyAbove(none,1.5,2)", "asPercent(none)", "removeEmptySeries(none)"):
        assert run(spark, target, [S("m", [1, 2])]) == {}, target


def test_all_absent(spark):
    rows = [S("m", [N, N, N])]
    check(run(spark, "maximumBelow(m,5)", rows), {"m": [N, N, N]})
    check(run(spark, "sum(m)", rows), {"sumSeries(m)": [N, N, N]})
    assert run(spark, "removeEmptySeries(m)", rows) == {}


@pytest.mark.parametrize("target", ["nosuch(m)", "sum()", "scale(m)", "scale(m,'x')", "movingWindow(m,2,'nope')", "summarize(m,'zz')", "consolidateBy(m,'nope')", "slo(m,'1s','nope',1)", "group('x')", "movingAverage(m,0)"])
def test_errors(spark, target):
    with pytest.raises(EvalError):
        run(spark, target, [S("m", [1, 2])])


def test_names_are_registered():
    for name in ("sumSeries", "rangeOfSeries", "holtWintersForecast", "ksTest2", "applyByNode", "aboveSeries", "seriesByTag", "areaBetween", "xFilesFactor"):
        assert name in REGISTRY
    assert len(REGISTRY) >= 210
