"""Queries over the driver's tables: one for each operator, with the DuckDB statement each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, commerce, reports, snapshots, streams, texts

Query = Callable[[SparkSession, str], DataFrame]

flagship = commerce.best_source_profit


def queries() -> dict[str, Query]:
    return {n: q for part in (commerce, snapshots, reports, catalogue, texts, streams) for n, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for part in (commerce, snapshots, reports, catalogue, texts, streams) for n, (_, sql) in part.QUERIES.items() if sql}
