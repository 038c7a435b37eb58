"""Loads all functions into the registry."""


def load() -> None:
    from . import bucket, combine, filters, forecast, generate, graph, moving, naming, rewrites, scalar, sequential, setops, shift, sorting  # noqa: F401
