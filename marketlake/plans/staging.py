"""Landing to raw to staged tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake import storage
from marketlake.contracts import RAW_OHLCV_V1, RAW_OHLCV_V2, Contract
from marketlake.operators.contract import enforce
from marketlake.operators.shape import (
    add_ingest_columns,
    bar_rules,
    dedup_latest,
    flag_rules,
    harmonise,
)
from marketlake.sources.landing import scan_landing

GRAIN = ["ticker_id", "trade_date"]
LATER_COLUMNS = {"value": "double", "foreign_room": "double"}


def ingest(
    df: DataFrame,
    batch_id: str,
    contract: Contract | None = None,
    schema_version: int = 1,
    source: str | None = None,
) -> DataFrame:
    """Check a drop against its contract, then stamp it; nothing is written on a violation."""
    checked = enforce(df, contract) if contract else df
    return add_ingest_columns(checked, batch_id, schema_version, source)


# Landing tables other than prices and the raw tables they become.
RAW_TABLES = {
    "foreign_flow_daily": "raw_foreign_flow",
    "corporate_actions": "raw_corporate_actions",
    "financial_ratios": "raw_financial_ratios",
    "tickers": "raw_tickers",
}


def with_version(prices: DataFrame) -> DataFrame:
    """Every row with its schema version; one that landed without is told by its columns.

    Only version 2 fills the later columns, so a row with none of them is version 1.
    """
    later = [F.col(c).isNotNull() for c in LATER_COLUMNS if c in prices.columns]
    told = F.when(reduce(or_, later, F.lit(False)), F.lit(2)).otherwise(F.lit(1))
    if "_schema_version" in prices.columns:
        told = F.coalesce(F.col("_schema_version").cast("int"), told)
    return prices.withColumn("_schema_version", told)


def ingest_landing(
    spark: SparkSession, landing: str, root: str, batch_id: str, run_date: str | None = None
) -> dict[str, str]:
    """Bring every landed table, or that of one run date, into its raw table.

    Absent tables are skipped. Prices become one table per schema version, each checked
    against its contract before anything of it is written; columns that only the other
    version has do not count. A version without a contract is an error.
    """
    paths: dict[str, str] = {}

    def store(name: str, df: DataFrame) -> None:
        paths[name] = f"{root}/{name}"
        storage.write_snapshot(df, paths[name])

    try:
        prices = scan_landing(spark, landing, "ohlcv_daily", run_date=run_date).drop("run_date")
    except FileNotFoundError:
        prices = None
    if prices is not None:
        prices = with_version(prices)
        known = {contract.version: contract for contract in (RAW_OHLCV_V1, RAW_OHLCV_V2)}
        # one small number a version, whatever the rows
        present = {row[0] for row in prices.select("_schema_version").distinct().collect()}
        unknown = sorted(present - set(known))
        if unknown:
            raise ValueError(f"no contract for schema versions {unknown} of ohlcv_daily")
        for version in sorted(present):
            rows = prices.filter(F.col("_schema_version") == version)
            store(
                f"raw_ohlcv_daily_v{version}", ingest(rows, batch_id, known[version], version)
            )
    for table, name in RAW_TABLES.items():
        try:
            df = scan_landing(spark, landing, table, run_date=run_date).drop("run_date")
        except FileNotFoundError:
            continue
        store(name, ingest(df, batch_id))
    return paths


def stage_daily_price(versions: list[DataFrame]) -> DataFrame:
    """One flagged bar per ticker and date from the raw schema versions."""
    merged = harmonise(versions, LATER_COLUMNS)
    return flag_rules(dedup_latest(merged, GRAIN, ["_ingested_at"]), bar_rules())


def stage_foreign_flow(raw: DataFrame) -> DataFrame:
    """Latest foreign-flow row per ticker and date."""
    return dedup_latest(raw, GRAIN, ["_ingested_at"])
