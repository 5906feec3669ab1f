"""Late rules, typed routes, and routing against a watermark of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake import storage
from marketlake.functions.columns import arrival_delay_exceeds

# Watermark delay and grace in seconds, and the columns of each route.
WATERMARK_SECONDS = 60
GRACE_SECONDS = 60
EVENT_TYPES = ["trade", "quote", "index_update"]
_HEAD = ["event_id", "event_ts", "created_ts_parsed", "session_type", "ticker", "exchange"]
_TAIL = ["source_offset", "kafka_ts", "_ingested_at"]
TRADE_COLUMNS = _HEAD + ["price", "quantity", "side", "trade_id"] + _TAIL + ["_late_flag"]
QUOTE_COLUMNS = (
    _HEAD + ["bid_price", "bid_qty", "ask_price", "ask_qty"] + _TAIL + ["_late_flag"]
)
QUARANTINE_COLUMNS = ["event_id", "event_type"] + _HEAD[1:] + _TAIL + ["reason"]


def flag_late(df: DataFrame, seconds: int = WATERMARK_SECONDS) -> DataFrame:
    """Mark events that arrived more than ``seconds`` after they happened."""
    return df.withColumn(
        "_late_flag", arrival_delay_exceeds("event_ts", "created_ts_parsed", seconds)
    )


def routes(flagged: DataFrame) -> dict[str, DataFrame]:
    """Trades and quotes on time, and the quarantine; index updates on time go nowhere.

    Unusable rows, late ones and events of a type that no route takes are quarantined,
    each with its reason.
    """
    unknown = ~F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.coalesce("_late_flag", F.lit(False)), "late_arrival")
        .when(unknown, "unknown_type")
    )
    judged = flagged.withColumn("reason", reason)
    on_time = judged.filter("reason IS NULL")
    held = judged.filter("reason IS NOT NULL")
    return {
        "stg_trades": on_time.filter("event_type = 'trade'").select(*TRADE_COLUMNS),
        "stg_quotes": on_time.filter("event_type = 'quote'").select(*QUOTE_COLUMNS),
        "stg_events_quarantine": held.select(*QUARANTINE_COLUMNS),
    }


def late_router(
    state_path: str,
    deliver: Callable[[DataFrame, DataFrame, int], None],
    delay_seconds: int = WATERMARK_SECONDS,
    grace_seconds: int = GRACE_SECONDS,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that splits each batch by the watermark before it.

    The watermark is the greatest event time of all earlier batches less
    ``delay_seconds``; events older than it by more than ``grace_seconds`` are late,
    events without a time pass. Stateful operators drop such rows without a trace, so
    this runs ahead of them. The running maximum is one row per batch, stored under the
    batch id: a retried batch sees the same watermark and gives the same split.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = None
        if storage.path_exists(spark, state_path):
            states = spark.read.schema("max_ts timestamp, batch_id bigint").parquet(state_path)
            known = states.filter(F.col("batch_id") < batch_id).agg(F.max("max_ts")).first()[0]
        batch = batch.persist()
        try:
            if known is None:
                late = F.lit(False)
            else:
                bound = F.lit(known) - F.make_dt_interval(
                    secs=F.lit(delay_seconds + grace_seconds)
                )
                late = F.coalesce(F.col("event_ts") < bound, F.lit(False))
            deliver(batch.filter(~late), batch.filter(late), batch_id)
            newest = batch.agg(F.max("event_ts").alias("max_ts"))
            newest.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return run
