"""Recurrences and transforms that no built-in expresses: one numpy pass per series.

Series go to Arrow workers as one row each (their values in order), so that a
worker holds one series at a time, whose length the request's range bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang import times
from ..model import SeriesFrame, V, renumber
from ..session import ship
from . import align
from .moving import _pair, look_back, pair_points, trim, window_of
from .registry import Args, EvalError, fmt, register
from .setops import concat


def per_series(f: SeriesFrame, fn: Callable[[np.ndarray], np.ndarray], extra: int = 0, together: bool = False) -> DataFrame:
    """`sid, ts, v` of a function of each series' values (NaN: absent); `extra` slots are added at the end.

    With `together` the function gets the series of a batch that have one length
    as the rows of a matrix, and gives as many rows.
    """
    rows = f.points.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ts", "v"))).alias("p")).select("sid", F.col("p.ts").alias("ts"), F.col("p.v").alias("vs"))
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            xs = [np.array([np.nan if v is None else v for v in vs], float) for vs in pdf["vs"]]
            done: dict[int, np.ndarray] = {}
            if together:
                for size in {len(x) for x in xs}:
                    at = [i for i, x in enumerate(xs) if len(x) == size]
                    done |= dict(zip(at, fn(np.stack([xs[i] for i in at]))))
            for i, (sid, ts) in enumerate(zip(pdf["sid"], pdf["ts"])):
                got = done[i] if together else fn(xs[i])
                t = np.asarray(ts, np.int64)
                if extra and len(t):
                    step = t[1] - t[0] if len(t) > 1 else 1
                    t = np.concatenate((t, t[-1] + step * np.arange(1, extra + 1)))
                out.append(pd.DataFrame({"sid": sid, "ts": t[len(t) - len(got) :], "v": got}))
            yield pd.concat(out) if out else pd.DataFrame({"sid": [], "ts": [], "v": []})

    done = rows.mapInPandas(run, "sid long, ts long, v double")
    return done.select("sid", "ts", F.nanvl("v", F.lit(None)).alias("v"))


def ewma_values(x: np.ndarray, alpha: float) -> np.ndarray:
    """m = alpha*x + (1-alpha)*m, begun with the first present value; absent values pass through."""
    out, m = np.full(len(x), np.nan), None
    for i, v in enumerate(x):
        if v == v:
            m = v if m is None else alpha * v + (1 - alpha) * m
            out[i] = m
    return out


def ema_values(x: np.ndarray, n: int, k: float) -> np.ndarray:
    """Begun with the mean of the first n values, absent ones as 0; rounded to six decimals."""
    filled = np.nan_to_num(x)
    if n > len(x):
        return np.array([round(float(filled.mean()), 6)]) if len(x) else x
    e = float(filled[:n].mean())
    out = [round(e, 6)]
    for v in x[n:]:
        if v == v:
            e = k * v + (1 - k) * e
            out.append(round(e, 6))
        else:
            out.append(np.nan)
    return np.array(out)


def holt_winters(x: np.ndarray, step: int, season: int, alpha: float = 0.1, beta: float = 0.0035, gamma: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Predictions and deviations of additive triple smoothing, with the usual deviation of each slot of the season.

    `x` holds one series or, as rows, several of one length, which move through
    time together. Per series there are a level, a trend and, for each slot of the
    season, an effect and a usual deviation:

        level     <- alpha (y - effect) + (1 - alpha) (level + trend)
        trend     <- beta (level - level before) + (1 - beta) trend
        effect    <- gamma (y - level) + (1 - gamma) effect
        deviation <- gamma |y - prediction| + (1 - gamma) deviation

    The first value predicts itself. An absent value has no level: the value after
    it is taken for the level, without a trend, and is predicted by nothing
    (which counts as 0); the slot's effect and deviation are 0 again.
    """
    rows = np.atleast_2d(x)
    n_series, n = rows.shape
    slots = max(2, season // step)
    effect, usual = np.zeros((slots, n_series)), np.zeros((slots, n_series))
    predictions, deviations = np.empty((n, n_series)), np.zeros((n, n_series))
    level, trend = rows[:, 0].copy() if n else np.zeros(n_series), np.zeros(n_series)
    ahead = level.copy()
    for i, y in enumerate(rows.T):
        slot, seen = i % slots, ~np.isnan(y)
        predictions[i] = ahead
        before = np.where(np.isnan(level), y, level)
        level = alpha * (y - effect[slot]) + (1 - alpha) * (before + trend)
        trend = np.where(seen, beta * (level - before) + (1 - beta) * trend, 0.0)
        usual[slot] = deviations[i] = np.where(seen, gamma * np.abs(y - np.nan_to_num(ahead)) + (1 - gamma) * usual[slot], 0.0)
        effect[slot] = np.where(seen, gamma * (y - level) + (1 - gamma) * effect[slot], 0.0)
        ahead = level + trend + effect[(i + 1) % slots]
    return (predictions.T, deviations.T) if np.ndim(x) == 2 else (predictions[:, 0], deviations[:, 0])


@register("ewma", "exponentialWeightedMovingAverage", group="Calculate", args="seriesList, alpha")
def ewma(ctx, a: Args) -> SeriesFrame:
    """The exponentially weighted mean."""
    alpha, f = a.number(1, "alpha"), a.series(0)
    return f.with_points(per_series(f, lambda x: ewma_values(x, alpha))).call(a.fn, fmt(alpha))


@register("exponentialMovingAverage", group="Calculate", args="seriesList, windowSize")
def ema(ctx, a: Args) -> SeriesFrame:
    """The exponential moving average of a window in points or seconds; the seconds set the constant of the latter."""
    n, seconds, shown = window_of(a, 1)
    f = align.common(look_back(ctx, a, n, seconds))
    k = 2.0 / ((n if n is not None else seconds) + 1)
    points = n if n is not None else seconds // f.common_step()
    if points < 1:
        raise EvalError("exponentialMovingAverage: the window is shorter than a step")
    return trim(ctx, f.with_points(per_series(f, lambda x: ema_values(x, points, k)))).call(a.fn, shown)


def _hw_args(ctx, a: Args, at: int) -> tuple[int, int]:
    return a.seconds(at, "bootstrapInterval", times.interval("7d")), a.seconds(at + 1, "seasonality", times.interval("1d"))


@register("holtWintersForecast", group="Calculate", args="seriesList, bootstrapInterval='7d', seasonality='1d'")
def hw_forecast(ctx, a: Args) -> SeriesFrame:
    """What triple exponential smoothing expects, learned from a period before the range."""
    boot, season = _hw_args(ctx, a, 1)
    f = align.common(a.series(0, ctx.start - boot, ctx.stop))
    step = f.common_step()
    return trim(ctx, f.with_points(per_series(f, lambda x: holt_winters(x, step, season)[0], together=True))).call(a.fn)


def _bands(ctx, a: Args) -> tuple[SeriesFrame, SeriesFrame]:
    delta = a.number(1, "delta", 3.0)
    boot, season = _hw_args(ctx, a, 2)
    f = align.common(a.series(0, ctx.start - boot, ctx.stop))
    step = f.common_step()

    def band(sign: int) -> Callable[[np.ndarray], np.ndarray]:
        def fn(x: np.ndarray) -> np.ndarray:
            p, d = holt_winters(x, step, season)
            return p + sign * delta * d

        return fn

    return tuple(trim(ctx, f.with_points(per_series(f, band(s), together=True))) for s in (-1, 1))


@register("holtWintersConfidenceBands", group="Calculate", args="seriesList, delta=3, bootstrapInterval='7d', seasonality='1d'")
def hw_bands(ctx, a: Args) -> SeriesFrame:
    """The expectation minus and plus delta deviations: two series for each."""
    low, high = _bands(ctx, a)
    both = concat([low.call("holtWintersConfidenceLower"), high.call("holtWintersConfidenceUpper")])
    n = F.max("ord").over(_all()) / 2
    place = F.when(F.col("ord") <= n, 2 * F.col("ord") - 1).otherwise(2 * (F.col("ord") - n))
    return both.with_series(renumber(both.series.withColumn("__p", place), F.col("__p")).drop("__p"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


@register("holtWintersConfidenceArea", group="Calculate", args="seriesList, delta=3, bootstrapInterval='7d', seasonality='1d'")
def hw_area(ctx, a: Args) -> SeriesFrame:
    """The bands, marked to be drawn as one area."""
    f = hw_bands(ctx, a)
    return f.with_series(f.series.withColumn("opts", F.map_concat("opts", F.create_map(F.lit("stacked"), F.lit("true"), F.lit("stackName"), F.lit("holtWintersConfidenceArea")))))


@register("holtWintersAberration", group="Calculate", args="seriesList, delta=3, bootstrapInterval='7d', seasonality='1d'")
def hw_aberration(ctx, a: Args) -> SeriesFrame:
    """How far values are beyond the bands; 0 within them and where absent."""
    low, high = _bands(ctx, a)
    now = align.common(a.series(0))
    bands = low.joined("name").select("name", "ts", F.col("v").alias("lo")).join(high.joined("name").select("name", "ts", F.col("v").alias("hi")), ["name", "ts"])
    rows = now.joined("name").join(bands, ["name", "ts"], "left")
    out = F.when(V() > F.col("hi"), V() - F.col("hi")).when(V() < F.col("lo"), V() - F.col("lo")).otherwise(0.0)
    return now.with_points(rows.select("sid", "ts", out.alias("v"))).call(a.fn)


@register("linearRegression", group="Calculate", args="seriesList, startSourceAt=None, endSourceAt=None")
def linear_regression(ctx, a: Args) -> SeriesFrame:
    """The straight line of least squares; all absent with fewer than two values."""
    from pyspark.sql import Window

    f = a.series(0)
    i = (F.row_number().over(Window.partitionBy("sid").orderBy("ts")) - 1).cast("double")
    rows = f.points.select("sid", "ts", "v", i.alias("i"))
    fits = rows.groupBy("sid").agg(F.regr_slope("v", "i").alias("b"), F.regr_intercept("v", "i").alias("a"), F.count("v").alias("n"))
    line = F.when(F.col("n") >= 2, F.col("a") + F.col("b") * F.col("i"))
    return f.with_points(rows.join(fits, "sid").select("sid", "ts", F.nanvl(line, F.lit(None)).alias("v"))).call(a.fn, *(n.text for n in a.node.args[1:]))


def polyfit_values(x: np.ndarray, degree: int, extra: int) -> np.ndarray:
    """The polynomial of least squares at each place; all absent with fewer than two values or no unique one."""
    at = np.arange(len(x) + extra, dtype=float)
    seen = ~np.isnan(x)
    if seen.sum() < max(2, degree + 1):
        return np.full(len(at), np.nan)
    size = max(1.0, float(len(x)))
    m = np.vander(at[: len(x)][seen] / size, degree + 1, increasing=True)
    c, *_ = np.linalg.lstsq(m, x[seen], rcond=None)
    return np.vander(at / size, degree + 1, increasing=True) @ c


@register("polyfit", group="Calculate", args="seriesList, degree=1, offset='0d'")
def polyfit(ctx, a: Args) -> SeriesFrame:
    """A polynomial of least squares, carried on for a while."""
    degree, offset = a.integer(1, "degree", 1), a.seconds(2, "offset", 0)
    f = a.series(0)
    extra = offset // f.common_step() if offset > 0 else 0
    points = per_series(f, lambda x: polyfit_values(x, degree, extra), extra)
    out = f.with_points(points).with_series(f.series.withColumn("stop", F.col("stop") + F.lit(extra) * F.col("step")))
    return out.call(a.fn, *(n.text for n in a.node.args[1:]))


def fft_part(x: np.ndarray, part: str) -> np.ndarray:
    # values are real, so the second half mirrors the first, and the middle frequency has no imaginary part
    half = np.fft.rfft(np.nan_to_num(x))
    c = np.concatenate((half, np.conj(half[1 : (len(x) + 1) // 2])[::-1]))
    return np.abs(c) if part == "abs" else np.arctan2(c.imag + 0.0, c.real)  # no negative zero


@register("fft", group="Transform", args="seriesList, mode")
def fft(ctx, a: Args) -> SeriesFrame:
    """The Fourier transform: absolute values, phases, or both as two series."""
    f, mode = a.series(0), a.string(1, "mode", "")
    parts = ["abs", "phase"] if mode in ("", "both", "all") else [mode]
    if not set(parts) <= {"abs", "phase"}:
        raise EvalError(f"fft: unknown mode {mode}")
    return concat([f.with_points(per_series(f, lambda x, p=p: fft_part(x, p))).call("fft", f"'{p}'") for p in parts])


@register("ifft", group="Transform", args="seriesList, phaseSeriesList")
def ifft(ctx, a: Args) -> SeriesFrame:
    """The size of the inverse Fourier transform of absolute values, with phases where given; lists meet by place."""
    f = a.series(0)
    if len(a) < 2:
        return f.with_points(per_series(f, lambda x: np.abs(np.fft.ifft(np.nan_to_num(x))))).call("ifft")
    g = a.series(1)
    names = g.series.select("ord", F.col("name").alias("other"))
    series = f.series.join(names, "ord", "left")
    phases = g.joined("ord").select("ord", "ts", F.col("v").alias("p"))
    both = f.joined("ord").join(phases, ["ord", "ts"], "left").select("sid", "ts", F.coalesce(V(), F.lit(0.0)).alias("v"), F.coalesce("p", F.lit(0.0)).alias("p"))
    rows = both.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ts", "v", "p"))).alias("p")).select("sid", F.col("p.ts").alias("ts"), F.col("p.v").alias("vs"), F.col("p.p").alias("ps"))
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sid, ts, vs, ps in zip(pdf["sid"], pdf["ts"], pdf["vs"], pdf["ps"]):
                c = np.asarray(vs, float) * np.exp(1j * np.asarray(ps, float))
                yield pd.DataFrame({"sid": sid, "ts": ts, "v": np.abs(np.fft.ifft(c))})

    shown = F.concat(F.lit("ifft("), F.col("name"), F.when(F.col("other").isNotNull(), F.concat(F.lit(","), F.col("other"))).otherwise(""), F.lit(")"))
    return SeriesFrame(series.withColumn("name", shown).drop("other"), rows.mapInPandas(run, "sid long, ts long, v double"), f.step)


def ks_two(x: np.ndarray, y: np.ndarray) -> float:
    """How likely two samples come from one distribution, by the asymptotic two-sample Kolmogorov-Smirnov test."""
    x, y = np.sort(x), np.sort(y)
    every = np.concatenate((x, y))
    d = float(np.max(np.abs(np.searchsorted(x, every, "right") / len(x) - np.searchsorted(y, every, "right") / len(y))))
    en = np.sqrt(len(x) * len(y) / (len(x) + len(y)))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 0.2:
        return 1.0
    j = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * j**2 * lam**2)))))


@register("kolmogorovSmirnovTest2", "ksTest2", group="Calculate", args="seriesList, seriesList, windowSize")
def ks_test(ctx, a: Args) -> SeriesFrame:
    """The rolling two-sample Kolmogorov-Smirnov value of the last n points of two series."""
    n = a.integer(2, "windowSize")
    left, right = _pair(a)
    rows = pair_points(left, right).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ts", "a", "b"))).alias("p")).select("sid", F.col("p.ts").alias("ts"), F.col("p.a").alias("xs"), F.col("p.b").alias("ys"))
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sid, ts, xs, ys in zip(pdf["sid"], pdf["ts"], pdf["xs"], pdf["ys"]):
                x, y = (np.array([np.nan if v is None else v for v in s], float) for s in (xs, ys))
                out = np.full(len(x), np.nan)
                for i in range(n, len(x)):
                    p, q = x[i - n + 1 : i + 1], y[i - n + 1 : i + 1]
                    p, q = p[~np.isnan(p)], q[~np.isnan(q)]
                    if len(p) and len(q):
                        out[i] = ks_two(p, q)
                yield pd.DataFrame({"sid": sid, "ts": ts, "v": out})

    done = rows.mapInPandas(run, "sid long, ts long, v double").select("sid", "ts", F.nanvl("v", F.lit(None)).alias("v"))
    return left.with_points(done).rename(F.lit(f"kolmogorovSmirnovTest2({a.node.args[0].text},{a.node.args[1].text},{n})"))
