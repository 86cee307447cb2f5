"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortica.plans import audit_queries, cohort_queries, event_queries, scalar_queries, voxel_queries

FLAGSHIP = "q_g2_long"
_PARTS = (cohort_queries, voxel_queries, scalar_queries, event_queries, audit_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
