"""Every query of the engine with its DuckDB statement, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import audit_queries, corpus_queries, record_queries, relational_queries, span_queries, vector_queries  # noqa: F401  they register themselves
from tessera.plans.registry import ORACLES, QUERIES, Query


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_queries.corpus_build(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
