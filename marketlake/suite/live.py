"""Streaming queries: each replays its input to the end and returns the stored result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake import storage
from marketlake.sources.messages import stream_table
from marketlake.streaming import dedup, jobs, routing, sinks, windows
from marketlake.streaming.parse import parse_events
from marketlake.suite.batch import ntz, rounded
from marketlake.suite.market import Market
from marketlake.suite.registry import query

# Tickers assumed by the burst rule of these sparse events.
BURST_TICKERS = 20_000


def _stored(m: Market, df: DataFrame, label: str) -> DataFrame:
    root = storage.work_dir(m.spark, label)
    sinks.drain(sinks.append_to(df, f"{root}/table", f"{root}/checkpoint"))
    return m.spark.read.schema(df.schema).parquet(f"{root}/table")


def _two_deliveries(m: Market) -> DataFrame:
    """Parsed events as a stream of two batches: purchases come after all the rest.

    Each delivery has as many files as there are cores, and a batch takes as many.
    """
    path = storage.work_dir(m.spark, "deliveries") + "/events"
    files = m.spark.sparkContext.defaultParallelism
    rows = m.tables.read("events")
    bought = F.col("event_type").eqNullSafe("purchase")  # before the JSON, so that each row is parsed once
    for some in (~bought, bought):
        parsed = parse_events(m.tables.raw_events(rows.filter(some)))
        parsed.repartition(files).write.mode("append").parquet(path)
    return stream_table(m.live, path, parsed.schema, files_per_batch=files)


@query
def stream_bronze(m: Market) -> DataFrame:
    root = storage.work_dir(m.spark, "stream-raw")
    for _ in range(2):  # the second start finds nothing new in its checkpoint
        sinks.drain(jobs.raw_job(m.live_raw(), root))
    raw = m.spark.read.parquet(f"{root}/raw_market_events")
    return raw.select(
        "source_offset", "source_partition", "source_topic", "kafka_key", ntz("kafka_ts")
    )


@query
def stream_dedup(m: Market) -> DataFrame:
    once = _stored(m, jobs.staged_events(m.live_raw()), "stream-dedup")
    return once.select("event_id", "event_type", "ticker", "_late_flag")


@query
def stream_dedup_salted(m: Market) -> DataFrame:
    once = _stored(m, jobs.staged_events(m.live_raw(), salt_on="source_offset"), "dedup-salted")
    return once.select("event_id", "event_type", "ticker")


@query
def stream_dedup_forever(m: Market) -> DataFrame:
    parsed = parse_events(m.live_raw())
    once = _stored(m, dedup.dedup_forever(parsed, "event_id"), "dedup-forever")
    return once.select("event_id", "event_type", "ticker")


@query
def stream_dedup_ttl(m: Market) -> DataFrame:
    parsed = parse_events(m.live_raw()).select("event_id", "event_type", "event_ts")
    once = _stored(m, dedup.dedup_with_ttl(parsed, "event_id", "event_ts", 600), "dedup-ttl")
    return once.select("event_id", "event_type")


@query
def stream_fanout(m: Market) -> DataFrame:
    root = storage.work_dir(m.spark, "fan-out")
    sinks.drain(jobs.staged_job(m.live_raw(), root))
    parts = [
        m.spark.read.parquet(f"{root}/{name}").select(
            F.lit(name).alias("route"), "event_id", ntz("event_ts"), "ticker"
        )
        for name in ("stg_trades", "stg_quotes", "stg_events_quarantine")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def tumbling_volume(m: Market) -> DataFrame:
    watched = m.live_trades().withWatermark("event_ts", "60 seconds")
    rows = _stored(m, windows.tumbling_volume(watched), "tumbling")
    return rows.select("ticker", ntz("window_start"), ntz("window_end"), "f_stream_volume_5m")


@query
def stream_features(m: Market) -> DataFrame:
    root = storage.work_dir(m.spark, "stream-features")
    sinks.drain(jobs.feature_job(m.live_trades(), root, BURST_TICKERS))
    rows = m.spark.read.parquet(f"{root}/feat_stream_intraday")
    return rows.select(
        "ticker_id",
        ntz("event_timestamp"),
        "f_stream_volume_5m",
        "f_stream_trade_count_30m",
        rounded("f_stream_price_momentum_30m"),
        "f_stream_burst_flag",
    )


@query
def stream_update_upsert(m: Market) -> DataFrame:
    root = storage.work_dir(m.spark, "upsert")
    trades = _two_deliveries(m).filter("event_type = 'trade'")
    lenient = trades.withWatermark("event_ts", "60 days")
    updating = windows.tumbling_volume(lenient)
    sinks.drain(sinks.upsert_changes(updating, f"{root}/changes", f"{root}/checkpoint"))
    latest = sinks.latest_state(m.spark, f"{root}/changes", ["ticker", "window_end"])
    return latest.select("ticker", ntz("window_end"), "f_stream_volume_5m")


@query
def late_router(m: Market) -> DataFrame:
    root = storage.work_dir(m.spark, "late-router")

    def deliver(on_time: DataFrame, late: DataFrame, batch_id: int) -> None:
        sinks.put_batch(on_time, f"{root}/accepted", batch_id)
        sinks.put_batch(late, f"{root}/late", batch_id)

    run = routing.late_router(f"{root}/state", deliver)
    sinks.drain(sinks.for_each_batch(_two_deliveries(m), run, f"{root}/checkpoint"))
    accepted = m.spark.read.parquet(f"{root}/accepted").withColumn("late", F.lit(False))
    late = m.spark.read.parquet(f"{root}/late").withColumn("late", F.lit(True))
    return accepted.unionByName(late).select("source_offset", "event_id", ntz("event_ts"), "late")


@query
def stream_json_sink(m: Market) -> DataFrame:
    root = storage.work_dir(m.spark, "json-sink")
    windows_5m = windows.tumbling_volume(m.live_trades().withWatermark("event_ts", "60 seconds"))
    query_ = sinks.append_to(windows_5m, f"{root}/windows", f"{root}/checkpoint", fmt="json")
    sinks.drain(query_)
    rows = m.spark.read.schema(windows_5m.schema).json(f"{root}/windows")
    return rows.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("f_stream_volume_5m").alias("volume")
    )
