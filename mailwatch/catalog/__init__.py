"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries, and the SQL of those that can be written in it."""
    from . import (
        aggregates, drift, evaluation, features, ingest, joins, logs, monitoring, scoring, storage, streaming,
        textual,
    )

    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for module in (
        features, ingest, textual, joins, aggregates, drift, monitoring, logs, evaluation, scoring, streaming, storage,
    ):
        for name, (run, sql) in module.QUERIES.items():
            if name in queries:
                raise ValueError(f"query registered twice: {name}")
            queries[name] = run
            if sql is not None:
                oracles[name] = sql
    return queries, oracles
