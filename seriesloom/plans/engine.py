"""From expressions to lazy DataFrames.

One recursive walk: each function asks for its arguments over the range it needs,
so look-back, shifts and nested calls compose. A pattern read twice over the same
range within a request is one scan (a memo here, a reused exchange in the plan).
Nothing runs before the caller acts on a result, but for the few small questions
documented where they are asked (steps, prefixes, a single value).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align, library
from ..functions.registry import FAILURES, REGISTRY, REWRITES, Args, EvalError
from ..lang.parser import Node, parse
from ..lang.times import at_time
from ..model import POINTS_DDL, SERIES_DDL, SeriesFrame, frame_of

library.load()


class Context:
    """One request: its range, source and memo."""

    def __init__(self, engine: "Engine", start: int, stop: int, now: int, bound: dict[str, SeriesFrame] | None = None, memo: dict | None = None):
        self.engine, self.start, self.stop, self.now = engine, start, stop, now
        self.bound = bound or {}
        self.memo = {} if memo is None else memo

    @property
    def spark(self) -> SparkSession:
        return self.engine.spark

    @property
    def source(self):
        return self.engine.source

    def at(self, start: int, stop: int) -> "Context":
        return self if (start, stop) == (self.start, self.stop) else Context(self.engine, start, stop, self.now, self.bound, self.memo)

    def bind(self, **frames: SeriesFrame) -> "Context":
        """A context in which names stand for given lists."""
        return Context(self.engine, self.start, self.stop, self.now, self.bound | frames, {})

    def eval(self, node: Node | str, start: int | None = None, stop: int | None = None) -> SeriesFrame:
        node = parse(node, self.engine.macros) if isinstance(node, str) else node
        ctx = self.at(self.start if start is None else start, self.stop if stop is None else stop)
        if node.kind == "name":
            return ctx.read(str(node.value))
        if node.kind == "number":
            step = max(1, ctx.stop - ctx.start)
            return frame_of(self.spark, [{"name": node.text, "start": ctx.start, "step": step, "values": [float(node.value)]}])
        if node.kind != "call":
            raise EvalError(f"{node.text} is no series list")
        name = str(node.value)
        if not node.args and not node.named:
            raise EvalError(f"{name} has no arguments")
        if name in REWRITES:
            from ..functions.setops import concat

            targets = REWRITES[name](ctx, Args(ctx, node))
            frames = [ctx.eval(t) for t in targets]
            return concat(frames) if frames else ctx.empty()
        if name not in REGISTRY:
            raise EvalError(f"unknown function {name}")
        return REGISTRY[name].build(ctx, Args(ctx, node))

    def read(self, pattern: str) -> SeriesFrame:
        if pattern in self.bound:
            return self.bound[pattern]
        key = (pattern, self.start, self.stop)
        if key not in self.memo:
            frame = self.source.scan(pattern, self.start, self.stop)
            self.memo[key] = align.common(frame) if self.engine.scale_to_common_step else frame
        return self.memo[key]

    def empty(self) -> SeriesFrame:
        return SeriesFrame(self.spark.createDataFrame([], SERIES_DDL), self.spark.createDataFrame([], POINTS_DDL), 1)


class Engine:
    """Plans requests over one source.

    `macros` are templates of expressions; `lookups` are DataFrames (key, value)
    or (key, row columns) that aliasByRedis and aliasByPostgres join with.
    """

    def __init__(self, spark: SparkSession, source, macros: dict[str, str] | None = None, lookups: dict[str, DataFrame] | None = None, scale_to_common_step: bool = True, reset_end: bool = False, format_alias: bool = True):
        self.spark, self.source = spark, source
        self.failed: dict[str, str] = {}
        self.macros, self.lookups = macros or {}, lookups or {}
        self.scale_to_common_step, self.reset_end, self.format_alias = scale_to_common_step, reset_end, format_alias

    def frame(self, target: str, start: int | str, until: int | str, now: int | None = None) -> SeriesFrame:
        """The list of one target over [start, until)."""
        now = int(time.time()) if now is None else now
        a, b = at_time(start, now), at_time(until, now)
        if a >= b:
            raise EvalError("the range is empty")
        return Context(self, a, b, now).eval(target)

    def render(self, targets: str | list[str], start: int | str, until: int | str, now: int | None = None, max_data_points: int = 0, tolerant: bool = False, **display) -> DataFrame:
        """`ord, name, ts, value` of all targets, lists one after the other, merged for display where asked (see max_points())."""
        frame = self.many(targets, start, until, now, tolerant)
        return (align.max_points(frame, max_data_points, **display) if max_data_points else frame).result()

    def query_range(self, target: str, start: int | str, until: int | str, now: int | None = None, most: int = 11_000, keep_least_within: int = 0) -> DataFrame:
        """render() at a step that gives `most` points at most, from the usual ones; for sources that can be read at any step."""
        now = int(time.time()) if now is None else now
        a, b = at_time(start, now), at_time(until, now)
        step = align.choose_step(a, b, most, self.source.step, keep_least_within)
        other = Engine(self.spark, self.source.at_step(step), self.macros, self.lookups, self.scale_to_common_step, self.reset_end, self.format_alias)
        return other.render(target, a, b, now)

    def many(self, targets: str | list[str], start: int | str, until: int | str, now: int | None = None, tolerant: bool = False) -> SeriesFrame:
        """The lists of all targets as one.

        With `tolerant` targets that cannot be planned are left out, and `failed`
        says why; only where none can be is that an error.
        """
        from ..functions.setops import concat

        targets = [targets] if isinstance(targets, str) else list(targets)
        now = int(time.time()) if now is None else now
        a, b = at_time(start, now), at_time(until, now)
        if a >= b:
            raise EvalError("the range is empty")
        ctx = Context(self, a, b, now)  # one memo, so equal patterns are read once
        frames, self.failed = [], {}
        for t in targets:
            try:
                frames.append(ctx.eval(t))
            except FAILURES as e:
                if not tolerant:
                    raise
                self.failed[t] = str(e)
        if not frames:
            raise EvalError("; ".join(f"{t}: {e}" for t, e in self.failed.items()) or "no targets")
        return concat(frames)


def function_catalogue(spark: SparkSession) -> DataFrame:
    """`name, group, signature, description` of every registered function."""
    rows = [(f.name, f.group, f.signature, f.doc) for f in REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, `group` string, signature string, description string").orderBy(F.col("name"))
