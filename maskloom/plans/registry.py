"""Registration of the runnable queries and their DuckDB counterparts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, stored: tuple[str, ...] = ()):
    """Register ``fn(views) -> DataFrame`` under a key; ``sql`` is the DuckDB form over the same views.

    ``stored`` views are written once when the query is called, for queries that read them several times.
    """
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views = Views(spark, sf_dir)
            views.store(*stored)
            return fn(views)
        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn
    return wrap
