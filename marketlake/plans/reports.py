"""Reports over frames, and stored tables made known to SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake import storage


def top_k(df: DataFrame, k: int, greatest: str, key: str) -> DataFrame:
    """The ``k`` rows with the greatest value; equal ones by ``key``, NULLs last."""
    return df.orderBy(F.col(greatest).desc_nulls_last(), key).limit(k)


def day_view(df: DataFrame, day: str, column: str = "trade_date") -> DataFrame:
    """Rows of one date; on a table stored by date, its folder alone is read."""
    return df.filter(F.col(column) == F.lit(day).cast("date"))


def leaders_by_mean(
    df: DataFrame, key: str, means: dict[str, tuple[str, int]], k: int, since: str, day: str = "trade_date"
) -> DataFrame:
    """Top ``k`` keys by their first mean from a date on.

    ``means`` gives each result column its measure and number of decimals.
    """
    recent = df.filter(F.col(day) >= F.lit(since).cast("date"))
    found = recent.groupBy(key).agg(
        *[F.round(F.avg(measure), digits).alias(name) for name, (measure, digits) in means.items()]
    )
    return top_k(found, k, next(iter(means)), key)


def with_attributes(df: DataFrame, attributes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add columns of a dimension; the planner decides how to join by their sizes."""
    return df.join(attributes.select(key, *columns), key)


def rollup_by(df: DataFrame, by: str, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(by).agg(*[measure.alias(name) for name, measure in measures.items()])


def register_tables(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Make stored tables known to SQL under their own names; absent ones are left out."""
    found = [n for n in names if storage.path_exists(spark, f"{root}/{n}")]
    for name in found:
        storage.read_table(spark, f"{root}/{name}").createOrReplaceTempView(name)
    return found


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe(spark: SparkSession, name: str) -> DataFrame:
    """Columns and types of a registered table."""
    return spark.sql("DESCRIBE IDENTIFIER(:name)", args={"name": name})
