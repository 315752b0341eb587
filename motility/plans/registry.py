"""Registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motility.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Views:
    """The domain views of one folder of base tables, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers ``f(views)`` as a query. ``sql`` may use the views named in ``views``; ``//`` is whole division."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = fixtures.with_views(views.split(), sql)
        return f

    return register
