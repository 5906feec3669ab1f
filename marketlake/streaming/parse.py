"""From raw messages to typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The payload of a market event.
EVENT_SCHEMA = (
    "event_id string, event_type string, event_timestamp string, created_ts string, "
    "session_type string, ticker string, exchange string, price double, quantity bigint, "
    "side string, trade_id string, bid_price double, bid_qty bigint, ask_price double, "
    "ask_qty bigint, index_name string, index_value double, index_change_pct double"
)


def unwrap(payload: str | Column) -> Column:
    """The message itself, or what it carries under ``payload``."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    return F.coalesce(F.get_json_object(payload, "$.payload"), payload)


def parse_events(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Typed events with ``event_ts``, ``created_ts_parsed`` and a ``reason`` when unusable.

    ``reason`` is ``bad_json`` for text that is no JSON object, ``missing_id`` for an event
    without an id, ``bad_event_time`` for a
    missing or unreadable event time, and NULL otherwise. Nothing is dropped.
    """
    keep = ["source_offset", "kafka_ts", "_ingested_at"] if keep is None else keep
    event = F.from_json(
        unwrap("payload_json"),
        EVENT_SCHEMA + ", _corrupt string",
        {"columnNameOfCorruptRecord": "_corrupt"},
    )
    flat = raw.select(event.alias("evt"), *keep).select(
        F.col("evt").isNull().alias("_none"), "evt.*", *keep
    )
    event_ts = F.try_to_timestamp("event_timestamp")
    reason = (
        F.when(F.col("_none") | F.col("_corrupt").isNotNull(), "bad_json")
        .when(F.col("event_id").isNull(), "missing_id")
        .when(event_ts.isNull(), "bad_event_time")
    )
    return flat.select(
        "*",
        event_ts.alias("event_ts"),
        F.try_to_timestamp("created_ts").alias("created_ts_parsed"),
        reason.alias("reason"),
    ).drop("_corrupt", "_none")


def event_time_or_arrival(event_ts: str = "event_ts", arrival: str = "kafka_ts") -> Column:
    """Event time, or the time of the log record when there is none."""
    return F.coalesce(F.col(event_ts), F.col(arrival))
