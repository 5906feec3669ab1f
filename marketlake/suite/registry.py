"""Names of the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlake.suite.market import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
    """Register a function of the market tables under its own name."""
    QUERIES[run.__name__] = lambda spark, folder: run(Market(spark, folder))
    return run
