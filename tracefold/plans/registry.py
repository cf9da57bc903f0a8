"""Registry of named queries: a Spark builder and (where SQL can say it) a SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def ntz(df: DataFrame) -> DataFrame:
    """Report timestamps as TIMESTAMP_NTZ (UTC wall clock) so every client reads the same value."""
    if not any(isinstance(f.dataType, T.TimestampType) for f in df.schema.fields):
        return df
    from pyspark.sql import functions as F
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
                       for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    """Decorator: add a (spark, sf_dir) -> DataFrame builder, and its SQL twin if given."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: ntz(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_records, q_guard, q_runs, q_artifacts, q_catalog, q_delegated, q_sources, q_messages  # noqa: F401
