"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from paywarden.plans.views import Views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Scope columns as SQL text.
S = "institution_id, regime, quarter, year"
P = "quarter, year"


def query(name: str, sql: str | None = None, more: tuple[str, ...] = (), raw: bool = False):
    """Register a query and, where SQL can express it, its oracle.

    The oracle starts from the derived tables unless ``raw``; ``more`` adds
    further table expressions.
    """

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql if raw else with_views(sql, *more)
        return fn

    return register


def same_scope(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("institution_id", "regime", "quarter", "year"))


def same_period(a: str, b: str) -> str:
    return f"{a}.quarter = {b}.quarter AND {a}.year = {b}.year"
