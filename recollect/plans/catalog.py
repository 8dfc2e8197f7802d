"""The registered queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import ship
from recollect.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a function; sql goes on with the relations of tables.SQL after a comma, or selects from them."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{t.SQL}{sql}"
        return function

    return register


def r6(name: str, value=None):
    return F.round(F.col(name) if value is None else value, 6).alias(name)
