"""Named queries over the driver's tables, each with the SQL that defines its rows.

A query is a function of the Model; what it does is in the operators, and here they are only put to the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..harness import Model, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of the Model under its name, with the SQL of its rows where SQL can say them."""

    def register(f: Callable[[Model], DataFrame]) -> Callable:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            ORACLES[key] = oracle(sql)
        return f

    return register


from . import q_bundle, q_ingest, q_joins, q_observe, q_parts, q_reading, q_records, q_retrieval, q_signals, q_text  # noqa: E402, F401
