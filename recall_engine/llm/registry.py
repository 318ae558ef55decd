"""Registers a query and its oracle side by side, as ``recall_queries.registry`` does for the rest."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (
    "url_vocabulary",
    "line_runs",
    "simhash",
    "winnowing",
    "target_ratio",
    "piece_agenda",
    "prefix_free",
    "merkle_audit",
    "range_coder",
    "separator_scan",
    "fill_middle",
    "source_divergence",
    "private_spans",
    "pipeline_query",
)
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return register


def load(module: str) -> None:
    """Imports one of ``MODULES``, which registers its queries."""
    import_module(f"recall_engine.llm.{module}")


def queries() -> dict[str, Query]:
    """Of the modules loaded so far."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
