"""All registered queries of the passage engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import analytics_queries, archive_queries, builder_queries, cleaning_queries, library_queries, lookup_queries, manifest_queries, reader_queries, retrieval_queries, source_queries, structure_queries, text_queries, workflow_queries  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
