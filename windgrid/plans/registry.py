"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Inputs:
    """in_.<view or table> is its DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Registers f(inputs) -> DataFrame, and the SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def r(x: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def count() -> Column:
    return F.count(F.lit(1)).cast("long")
