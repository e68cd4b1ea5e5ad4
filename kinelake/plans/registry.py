"""All registered queries and their DuckDB twins, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align_queries, convert_queries, long_queries, pose_queries, recording_queries, resample_queries, record_queries, source_queries, state_queries, store_queries, stream_queries, table_queries, window_queries

MODULES = (align_queries, pose_queries, window_queries, resample_queries, table_queries, state_queries, source_queries, convert_queries, record_queries, recording_queries, stream_queries, long_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
