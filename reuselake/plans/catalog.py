"""Named queries and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reuselake.plans.fixtures import Lake, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", recursive: bool = False):
    """Register ``fn(lake)`` under ``name`` with its check SQL over the given fixture views."""

    def register(fn: Callable[[Lake], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the test tables and their SQL know no zone; days must start at the same moment
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Lake(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            if views:
                ORACLES[name] = with_views(sql, *views.split(), recursive=recursive)
            else:
                ORACLES[name] = sql
        return fn

    return register
