"""Named queries and the SQL each is checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(x, name: str, digits: int = 6) -> Column:
    """Rounded result column; float sums differ in the last bits between shuffle orders."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits).alias(name)
