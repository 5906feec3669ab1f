"""Windowed aggregates for batch frames and for streams with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Window sizes, and the parts of the burst threshold.
TUMBLING = "5 minutes"
SLIDING, SLIDE = "30 minutes", "1 minute"
SLIDE_STEPS = 30
BURST_FACTOR = 5
BASE_EVENTS_PER_MINUTE = 200
DEFAULT_TICKERS = 400


def _bounded(df: DataFrame, key: str) -> DataFrame:
    """Flatten the window column."""
    others = [c for c in df.columns if c not in ("window", key)]
    return df.select(
        key,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *others,
    )


def tumbling_volume(trades: DataFrame, key: str = "ticker", ts: str = "event_ts") -> DataFrame:
    """Traded quantity per key and five-minute window."""
    return _bounded(
        trades.groupBy(F.window(ts, TUMBLING), key).agg(
            F.sum("quantity").alias("f_stream_volume_5m")
        ),
        key,
    )


def sliding_momentum(
    trades: DataFrame, key: str = "ticker", ts: str = "event_ts", slide: str = SLIDE
) -> DataFrame:
    """Trade count, first and last price per key over 30 minutes, every minute or ``slide``."""
    return _bounded(
        trades.groupBy(F.window(ts, SLIDING, slide), key).agg(
            F.count(F.lit(1)).alias("f_stream_trade_count_30m"),
            F.min_by("price", ts).alias("first_price"),
            F.max_by("price", ts).alias("last_price"),
        ),
        key,
    )


def sliding_momentum_backfill(
    trades: DataFrame, key: str = "ticker", ts: str = "event_ts"
) -> DataFrame:
    """The same rows as ``sliding_momentum`` for a batch, built from one-minute panes.

    Trades shrink to one row per key and minute before anything is repeated over the
    30 windows that contain the minute.
    """
    panes = trades.groupBy(key, F.date_trunc("minute", ts).alias("pane")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first_ts"),
        F.min_by("price", ts).alias("pane_first"),
        F.max(ts).alias("last_ts"),
        F.max_by("price", ts).alias("pane_last"),
    )
    ends = F.explode(F.sequence(F.lit(1), F.lit(SLIDE_STEPS)))
    end = F.col("pane") + F.make_dt_interval(mins=F.col("step"))
    return (
        panes.withColumn("step", ends)
        .withColumn("window_end", end)
        .groupBy(key, "window_end")
        .agg(
            F.sum("n").alias("f_stream_trade_count_30m"),
            F.min_by("pane_first", "first_ts").alias("first_price"),
            F.max_by("pane_last", "last_ts").alias("last_price"),
        )
        .select(
            key,
            (F.col("window_end") - F.make_dt_interval(mins=F.lit(SLIDE_STEPS))).alias("window_start"),
            "window_end",
            "f_stream_trade_count_30m",
            "first_price",
            "last_price",
        )
    )


def burst_threshold(tickers: int = DEFAULT_TICKERS) -> float:
    """Trades in 30 minutes above which a ticker is in a burst."""
    return BURST_FACTOR * BASE_EVENTS_PER_MINUTE * SLIDE_STEPS / max(tickers, 1)


def assemble_features(
    volume: DataFrame, momentum: DataFrame, tickers: int = DEFAULT_TICKERS, key: str = "ticker"
) -> DataFrame:
    """Stream features per ticker where a five-minute and a 30-minute window end together."""
    joined = volume.drop("window_start").join(
        momentum.drop("window_start"), [key, "window_end"], "inner"
    )
    first, last = F.col("first_price"), F.col("last_price")
    return joined.select(
        F.col(key).alias("ticker_id"),
        F.col("window_end").alias("event_timestamp"),
        F.current_timestamp().alias("created_ts"),
        F.coalesce("f_stream_volume_5m", F.lit(0)).alias("f_stream_volume_5m"),
        F.coalesce("f_stream_trade_count_30m", F.lit(0)).alias("f_stream_trade_count_30m"),
        F.when(first > 0, (last - first) / first).alias("f_stream_price_momentum_30m"),
        (F.col("f_stream_trade_count_30m") > F.lit(burst_threshold(tickers)))
        .cast("int")
        .alias("f_stream_burst_flag"),
    )


def stream_features(
    trades: DataFrame, tickers: int = DEFAULT_TICKERS, key: str = "ticker", ts: str = "event_ts"
) -> DataFrame:
    """Both windows over one trade stream, joined when they close.

    Only sliding windows that end with a tumbling one can be joined, so they slide by its
    length: one in five is computed and kept.
    """
    momentum = sliding_momentum(trades, key, ts, slide=TUMBLING)
    return assemble_features(tumbling_volume(trades, key, ts), momentum, tickers, key)


def session_activity(
    events: DataFrame, key: str, ts: str, gap: str, aggs: dict[str, Column]
) -> DataFrame:
    """Aggregates per burst of activity: a session ends after ``gap`` without events."""
    grouped = events.groupBy(F.session_window(ts, gap), key).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )
    return grouped.select(
        key,
        F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"),
        *aggs,
    )
