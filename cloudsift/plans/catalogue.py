"""Registry of the queries over the driver's tables, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudsift.plans import chart_queries, dataset_queries, events, explorers, hunts, ingest, row_hunt_queries, streams

FLAGSHIP = "o54_burst_hunt"
MODULES = (events, ingest, hunts, dataset_queries, explorers, streams, chart_queries, row_hunt_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """All SQL by name."""
    return {name: s for m in MODULES for name, s in m.SQL.items()}
