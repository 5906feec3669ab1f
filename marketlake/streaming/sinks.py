"""Checkpointed sinks: append, fan-out, keyed upsert, JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _trigger(writer, available_now: bool, every: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


def append_to(
    df: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = True,
    every: str = "30 seconds",
) -> StreamingQuery:
    """Append a stream to a folder; ``fmt`` json gives JSON lines. Each row lands once."""
    writer = (
        df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, available_now, every).start(path)


def for_each_batch(
    df: DataFrame,
    run: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    available_now: bool = True,
    every: str = "30 seconds",
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return _trigger(writer.foreachBatch(run), available_now, every).start()


def put_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch under its id; a retry replaces what a failed attempt left."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def fan_out(
    df: DataFrame,
    split: Callable[[DataFrame], dict[str, DataFrame]],
    root: str,
    checkpoint: str,
    available_now: bool = True,
    every: str = "30 seconds",
) -> StreamingQuery:
    """One stream to several tables by one query: parsed once, one dedup state."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, part in split(batch).items():
                put_batch(part, f"{root}/{name}", batch_id)
        finally:
            batch.unpersist()

    return for_each_batch(df, run, checkpoint, "append", available_now, every)


def upsert_changes(
    df: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    every: str = "30 seconds",
) -> StreamingQuery:
    """Keep the changes of an updating aggregate, batch by batch.

    A window that is updated by late rows is written again; ``latest_state`` picks the
    newest version. Only changed rows are written, never the table as a whole.
    """
    return for_each_batch(
        df, lambda batch, i: put_batch(batch, path, i), checkpoint, "update", available_now, every
    )


def latest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key from a change table."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in keys and c != "batch_id"]
    newest = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch_id").alias("_v")
    )
    return newest.select(*keys, "_v.*")


def start_all(starters: list[Callable[[], StreamingQuery]]) -> list[StreamingQuery]:
    """Start several queries; when one fails to start, stop those already running."""
    running: list[StreamingQuery] = []
    try:
        for start in starters:
            running.append(start())
    except Exception:
        for query in running:
            query.stop()
        raise
    return running


def drain(query: StreamingQuery) -> None:
    """Wait for a finite replay; its error, if any, is raised here."""
    query.awaitTermination()
