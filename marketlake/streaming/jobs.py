"""The three live jobs: raw log, staged events, stream features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlake.streaming.dedup import dedup_within_watermark
from marketlake.streaming.parse import event_time_or_arrival, parse_events
from marketlake.streaming.routing import WATERMARK_SECONDS, flag_late, routes
from marketlake.streaming.sinks import append_to, fan_out
from marketlake.streaming.windows import DEFAULT_TICKERS, stream_features


def raw_job(envelopes: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Append envelope rows as they come."""
    return append_to(
        envelopes, f"{root}/raw_market_events", f"{root}/_checkpoints/raw", **trigger
    )


def staged_events(
    raw: DataFrame, seconds: int = WATERMARK_SECONDS, salt_on: str | None = None
) -> DataFrame:
    """Parsed events, each id once, with the late flag.

    The flag depends on the row alone and is set before the dedup. Rows without an event
    time use the time of the log record for the watermark, and rows without an id their
    place in the log for the dedup, so that all of them reach the quarantine.
    """
    keep = ["source_offset", "source_partition", "kafka_ts", "_ingested_at"]
    place = F.concat_ws(":", F.lit("offset"), "source_partition", "source_offset")
    flagged = flag_late(parse_events(raw, keep), seconds).withColumns(
        {"_watermark_ts": event_time_or_arrival(), "_id": F.coalesce("event_id", place)}
    )
    return dedup_within_watermark(flagged, "_id", "_watermark_ts", f"{seconds} seconds", salt_on)


def staged_job(raw: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Trades, quotes and quarantine from one query."""
    return fan_out(staged_events(raw), routes, root, f"{root}/_checkpoints/staged", **trigger)


def feature_job(
    trades: DataFrame, root: str, tickers: int = DEFAULT_TICKERS, every: str = "1 minute", **trigger
) -> StreamingQuery:
    """Stream features from staged trades."""
    watched = trades.withWatermark("event_ts", f"{WATERMARK_SECONDS} seconds")
    return append_to(
        stream_features(watched, tickers),
        f"{root}/feat_stream_intraday",
        f"{root}/_checkpoints/features",
        every=every,
        **trigger,
    )
