"""Quality, burst and reconciliation profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_metrics(row: DataFrame) -> DataFrame:
    """One-row frame to (metric, value) rows."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in row.columns
        ]
    )
    return row.select(F.inline(rows))


def bar_profile(bars: DataFrame, in_group: Column) -> DataFrame:
    """Group share of volume, cardinalities, rows per schema version, NULLs, duplicates.

    Distinct counts come from one grouping on (key, date); the other figures are carried
    along as partial sums, so rows are shuffled once and only after a map-side combine.
    """
    pairs = bars.groupBy("ticker_id", "trade_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("volume").alias("volume"),
        F.sum(F.when(in_group, F.col("volume")).otherwise(0)).alias("inside"),
        F.count_if(F.col("_schema_version") == 1).alias("v1"),
        F.count_if(F.col("_schema_version") == 2).alias("v2"),
        F.count_if(F.col("value").isNull()).alias("no_value"),
        F.count_if(F.col("foreign_room").isNull()).alias("no_room"),
    )
    return as_metrics(
        pairs.agg(
            F.sum("n").alias("rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.count_distinct("ticker_id").alias("distinct_tickers"),
            F.count_distinct("trade_date").alias("distinct_dates"),
            F.sum("v1").alias("version_1_rows"),
            F.sum("v2").alias("version_2_rows"),
            F.sum("no_value").alias("null_value_rows"),
            F.sum("no_room").alias("null_room_rows"),
            (F.sum("n") - F.count(F.lit(1))).alias("duplicate_rows"),
            ((F.sum("n") - F.count(F.lit(1))) * 100.0 / F.sum("n")).alias("duplicate_pct"),
            (F.sum("inside") * 100.0 / F.sum("volume")).alias("group_volume_pct"),
        )
    )


def event_profile(events: DataFrame, event_id: str, event_ts: str, arrival_ts: str) -> DataFrame:
    """Late and duplicate events, busiest and average minute, and their ratio."""
    ids = events.groupBy(event_id).agg(F.count(F.lit(1)).alias("n"))
    unique = ids.agg(F.count(F.lit(1)).alias("u"))
    minutes = events.groupBy(F.date_trunc("minute", F.col(event_ts)).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col(event_ts).eqNullSafe(F.col(arrival_ts))).alias("late"),
    )
    return as_metrics(
        minutes.agg(
            F.sum("n").alias("events"),
            F.sum("late").alias("late_events"),
            (F.sum("late") * 100.0 / F.sum("n")).alias("late_pct"),
            (F.sum("n") - unique.scalar()).alias("duplicate_events"),
            F.max("n").alias("peak_per_minute"),
            (F.sum("n") / F.count(F.lit(1))).alias("average_per_minute"),
            (F.max("n") * F.count(F.lit(1)) / F.sum("n")).alias("peak_to_average"),
        )
    )


def reconcile(trades: DataFrame, bars: DataFrame, order: str) -> DataFrame:
    """Compare intraday trades with daily bars per ticker and date, both sides kept.

    Trades are summed up before the join; both sides then share one partitioning.
    """
    keys = ["ticker_id", "trade_date"]
    intraday = trades.groupBy(*keys).agg(
        F.sum("quantity").alias("trade_quantity"),
        F.min("price").alias("trade_low"),
        F.max("price").alias("trade_high"),
        F.max_by("price", order).alias("trade_last"),
    )
    daily = bars.select(*keys, "volume", "low", "high", "close")
    return intraday.join(daily, keys, "full").select(
        *keys,
        "trade_quantity",
        "volume",
        (F.col("trade_quantity") == F.col("volume")).alias("quantity_matches"),
        ((F.col("trade_low") >= F.col("low")) & (F.col("trade_high") <= F.col("high"))).alias(
            "prices_inside"
        ),
        (F.col("trade_last") == F.col("close")).alias("last_is_close"),
    )
