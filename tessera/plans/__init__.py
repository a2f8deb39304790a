"""The engine's named queries and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import access, documents, lookups, scalars, search, tabled
from tessera.plans.registry import QUERIES, SQL, Query
from tessera.session import prepare

__all__ = ["access", "documents", "lookups", "oracle_sql", "queries", "scalars", "search", "tabled"]


def _prepared(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(prepare(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
