"""Fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.columns import action_factor
from marketlake.operators.adjust import back_adjust
from marketlake.operators.shape import upsert

PRICE_COLUMNS = [
    "ticker_id",
    "trade_date",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "value",
    "foreign_room",
    "_schema_version",
]


def price_factors(actions: DataFrame) -> DataFrame:
    """Corporate actions with their price factor; cash dividends have none."""
    return actions.select(
        "ticker_id",
        F.col("ex_date").cast("date").alias("action_date"),
        action_factor("action_type", "ratio").alias("factor"),
    )


def current_rows(dim_ticker: DataFrame, *columns: str) -> DataFrame:
    return dim_ticker.filter("is_current").select("ticker_id", *columns)


def with_date_key(df: DataFrame, dim_date: DataFrame, day: str) -> DataFrame:
    """Look up the calendar key. The calendar has one row per date between the first and
    the last; one wild date makes it long, so Spark decides by its size how to join.
    """
    return df.join(dim_date.select(F.col("calendar_date").alias(day), "date_key"), day, "left")


def build_fact_daily_price(
    staged: DataFrame,
    dim_ticker: DataFrame | None = None,
    dim_date: DataFrame | None = None,
    actions: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Daily prices with dimension keys and the back-adjusted close.

    ``keep`` names further columns of the staged prices to carry along, such as the net
    foreign value joined to them while both are still partitioned by ticker and date.

    The adjustment leaves rows partitioned by ticker, which is also the key of the
    ticker lookup and of every later window over the fact. The lookup has no hint: it is
    broadcast when its size is known to be small, and merged on that partitioning when not.
    """
    fact = back_adjust(
        staged.select(*PRICE_COLUMNS, *(keep or [])),
        price_factors(actions) if actions is not None else None,
        "ticker_id",
        "trade_date",
        "close",
        "action_date",
        "factor",
    )
    keys = []
    if dim_ticker is not None:
        fact = fact.join(current_rows(dim_ticker, "ticker_key"), "ticker_id", "left")
        keys.append("ticker_key")
    if dim_date is not None:
        fact = with_date_key(fact, dim_date, "trade_date")
        keys.append("date_key")
    return fact.select(
        *keys,
        *PRICE_COLUMNS,
        *(keep or []),
        "adj_close",
        F.current_timestamp().alias("created_ts"),
    )


def build_fact_foreign_flow(staged_flow: DataFrame) -> DataFrame:
    return staged_flow.withColumn(
        "foreign_net_value", F.col("foreign_buy_value") - F.col("foreign_sell_value")
    )


def build_fact_intraday_trade(
    trades: DataFrame, dim_ticker: DataFrame, dim_date: DataFrame, dim_session: DataFrame
) -> DataFrame:
    """Deduplicated trades with value and dimension keys.

    Sessions are four rows and are broadcast. The ticker lookup
    is left to the optimiser, which knows the size.
    """
    sessions = F.broadcast(dim_session.withColumnRenamed("session_type", "_session"))
    base = trades.withColumnRenamed("ticker", "ticker_id").withColumns(
        {
            "trade_date": F.to_date("event_ts"),
            "trade_value": F.col("price") * F.col("quantity"),
        }
    )
    keyed = base.join(current_rows(dim_ticker, "ticker_key"), "ticker_id", "left").join(
        sessions, F.upper("session_type") == F.col("_session"), "left"
    )
    return with_date_key(keyed, dim_date, "trade_date").select(
        "trade_id",
        "event_id",
        "ticker_id",
        "trade_date",
        "event_ts",
        "created_ts_parsed",
        "price",
        "quantity",
        "trade_value",
        "side",
        "ticker_key",
        "date_key",
        "session_key",
    )


def upsert_facts(fact: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge a new batch into a fact by its grain."""
    return upsert(fact, changes, ["ticker_id", "trade_date"])
