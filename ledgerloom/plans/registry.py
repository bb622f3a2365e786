"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans.views import duckdb_ctes, open_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: list[str], oracle: str | None = None):
    """Register ``fn(views...)``; ``oracle`` is a SELECT over the same view names."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*open_views(spark, sf_dir, views))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = f"{duckdb_ctes(views)} SELECT * FROM ({oracle}) AS answer"
        return fn

    return wrap
