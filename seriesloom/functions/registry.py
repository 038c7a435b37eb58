"""Names, builders and descriptions of all functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException

from ..lang import times
from ..lang.parser import Node, ParseError


class EvalError(ValueError):
    """A call that cannot be planned: unknown function, missing or bad argument."""


#: What a target can fail with before anything runs: a call, its text, or a source that cannot be read.
FAILURES = (EvalError, ParseError, PySparkException, OSError)


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable
    group: str
    signature: str
    aliases: tuple[str, ...]

    @property
    def doc(self) -> str:
        return inspect.getdoc(self.build) or ""


REGISTRY: dict[str, Function] = {}
REWRITES: dict[str, Callable] = {}


def register(*names: str, group: str, args: str = "seriesList"):
    """Registers a builder (ctx, args) -> SeriesFrame under all its names; a later one of a name wins."""

    def add(fn: Callable) -> Callable:
        for n in names:
            REGISTRY[n] = Function(n, fn, group, f"{n}({args})", names)
        return fn

    return add


def rewrite(*names: str):
    """Registers a rewriter (ctx, args) -> list of expressions."""

    def add(fn: Callable) -> Callable:
        for n in names:
            REWRITES[n] = fn
            REGISTRY[n] = Function(n, fn, "Rewrite", f"{n}(...)", names)
        return fn

    return add


#: The driver plans an expression for each of so many rows at most.
MOST_PLANS = 1000


def few(rows, what: str) -> list:
    """The rows of a small DataFrame; an error where there are more than the driver may plan for."""
    got = rows.limit(MOST_PLANS + 1).collect()
    if len(got) > MOST_PLANS:
        raise EvalError(f"more than {MOST_PLANS} {what}")
    return got


_MISSING = object()


class Args:
    """The arguments of one call, taken by position or name and coerced."""

    def __init__(self, ctx, node: Node):
        self.ctx, self.node = ctx, node
        self.fn = str(node.value)

    def __len__(self) -> int:
        return len(self.node.args)

    def get(self, i: int, name: str | None = None) -> Node | None:
        if name and name in self.node.named:
            return self.node.named[name]
        return self.node.args[i] if i < len(self.node.args) else None

    def _value(self, i: int, name: str | None, default, convert):
        node = self.get(i, name)
        if node is None or (node.kind == "name" and str(node.value).lower() == "none"):
            if default is _MISSING:
                raise EvalError(f"{self.fn} lacks its argument {name or i + 1}")
            return default
        try:
            return convert(node)
        except (TypeError, ValueError) as e:
            raise EvalError(f"{self.fn}: bad argument {node.text}: {e}") from None

    def number(self, i: int, name: str | None = None, default=_MISSING) -> float:
        def convert(n: Node) -> float:
            if str(n.value).lower() in ("inf", "infinity"):
                return float("inf")
            return float(n.value)  # strings of digits are numbers too

        return self._value(i, name, default, convert)

    def integer(self, i: int, name: str | None = None, default=_MISSING) -> int:
        def convert(n: Node) -> int:
            x = int(n.value, 0) if isinstance(n.value, str) else n.value
            if x != int(x):
                raise ValueError("a whole number is wanted")
            return int(x)

        return self._value(i, name, default, convert)

    def string(self, i: int, name: str | None = None, default=_MISSING) -> str:
        def convert(n: Node) -> str:
            if n.kind != "string":
                raise ValueError("a string is wanted")
            return str(n.value)

        return self._value(i, name, default, convert)

    def boolean(self, i: int, name: str | None = None, default=_MISSING) -> bool:
        def convert(n: Node) -> bool:
            if n.kind == "bool":
                return bool(n.value)
            if str(n.value) in ("True", "true", "1", "1.0"):
                return True
            if str(n.value) in ("False", "false", "0", "0.0"):
                return False
            raise ValueError("true or false is wanted")

        return self._value(i, name, default, convert)

    def seconds(self, i: int, name: str | None = None, default=_MISSING, sign: int = 1) -> int:
        return self._value(i, name, default, lambda n: times.interval(str(n.value), sign))

    def is_string(self, i: int, name: str | None = None) -> bool:
        n = self.get(i, name)
        return n is not None and n.kind == "string"

    def nodes(self, begin: int) -> list[int | str]:
        """Path nodes (numbers) and tags (strings) from a position on."""
        out: list[int | str] = []
        for k, n in enumerate(self.node.args[begin:]):
            out.append(self.integer(begin + k) if n.kind == "number" else str(n.value))
        return out

    def series(self, i: int = 0, start: int | None = None, stop: int | None = None):
        node = self.node.args[i] if i < len(self.node.args) else None
        if node is None:
            raise EvalError(f"{self.fn} lacks a series list")
        if node.kind in ("string", "bool"):
            raise EvalError(f"{self.fn}: {node.text} is no series list")
        return self.ctx.eval(node, start, stop)

    def all_series(self, begin: int = 0):
        """All arguments from a position on as one list."""
        from .setops import concat

        frames = [self.series(i) for i in range(begin, len(self.node.args))]
        if not frames:
            raise EvalError(f"{self.fn} lacks a series list")
        return frames[0] if len(frames) == 1 else concat(frames)


def fmt(x: float) -> str:
    """A number as results carry it in their names."""
    return f"{x:g}" if abs(x) < 1e16 else repr(x)
