"""Collects the query modules; a query and its oracle are registered side by side under one name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.session import METHOD_LIMIT

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (
    "history_queries",
    "vocab_queries",
    "dataset_queries",
    "stream_queries",
    "model_queries",
    "proof_queries",
)
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 digits, all integers as BIGINT."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set(*METHOD_LIMIT)
            return tidy(function(spark, sf_dir))

        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"recall_queries.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
