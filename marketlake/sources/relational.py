"""Relational tables over JDBC."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(dsn: str) -> dict[str, str]:
    """Turn ``scheme://user:password@host:port/name`` into JDBC options; JDBC URLs pass."""
    if dsn.startswith("jdbc:"):
        return {"url": dsn}
    parts = urlparse(dsn)
    port = f":{parts.port}" if parts.port else ""
    options = {"url": f"jdbc:{parts.scheme}://{parts.hostname}{port}{parts.path}"}
    if parts.username:
        options["user"] = parts.username
    if parts.password:
        options["password"] = parts.password
    return options


def scan_relation(
    spark: SparkSession,
    dsn: str,
    table: str,
    split_on: str | None = None,
    bounds: tuple | None = None,
    splits: int = 16,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Read a table; with ``split_on`` and ``bounds`` by ``splits`` tasks side by side.

    Filters and column choices on the result are pushed into the database.
    """
    reader = spark.read.format("jdbc").options(
        **jdbc_options(dsn), dbtable=table, fetchsize=str(fetch_size)
    )
    if split_on and bounds:
        reader = reader.options(
            partitionColumn=split_on,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(splits),
        )
    return reader.load()


def scan_or_else(
    primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame]
) -> DataFrame:
    """First source, or the second when the first cannot even give its schema."""
    try:
        df = primary()
        df.schema  # noqa: B018  resolving the schema contacts the source
        return df
    except Exception:  # noqa: BLE001  any failure of the source selects the fallback
        return fallback()


def refresh_relation(df: DataFrame, dsn: str, table: str, batch_size: int = 10_000) -> None:
    """Empty an existing table and refill it, keeping its definition and grants."""
    options = jdbc_options(dsn)
    # fails when the table is absent, before anything is emptied
    df.sparkSession.read.format("jdbc").options(**options, dbtable=table).load().schema  # noqa: B018
    (
        df.write.format("jdbc")
        .mode("overwrite")
        .options(**options, dbtable=table, truncate="true", batchsize=str(batch_size))
        .save()
    )
