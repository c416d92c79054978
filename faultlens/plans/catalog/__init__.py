"""The registered queries, one per operator, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def load() -> None:
    """Fill the registry."""
    from faultlens.plans.catalog import files, findings, ingest, logs, rules, tech  # noqa: F401, I001
    from faultlens.plans.catalog import combined  # noqa: F401
