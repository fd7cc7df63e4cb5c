"""Collects the queries that the engine's modules register, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "month_calendar"
_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator for ``f(spark, sf_dir) -> DataFrame``."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return keep


def oracle(name: str) -> str:
    """SQL of a query that is registered already, for another way to the same rows."""
    return _ORACLES[name]


def _load() -> None:
    from . import plans

    plans.load()


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
