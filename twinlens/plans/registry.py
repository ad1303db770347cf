"""Registered queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load_all() -> None:
    """Import the query modules, which register themselves."""
    from twinlens.plans import (  # noqa: F401
        queries_diversity,
        queries_fidelity,
        queries_generate,
        queries_privacy,
        queries_profile,
        queries_score,
        queries_utility,
    )
