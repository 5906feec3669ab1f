"""Message-log sources with one envelope, whatever carries the messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.columns import as_col
from marketlake.storage import is_directory

# The envelope every raw event carries.
ENVELOPE_SCHEMA = (
    "payload_json string, source_offset bigint, source_partition bigint, source_topic string, "
    "kafka_ts timestamp, kafka_key string, _ingested_at timestamp"
)


def read_log(
    spark: SparkSession,
    servers: str,
    topic: str,
    starting_offsets: str = "latest",
    min_partitions: int | None = None,
) -> DataFrame:
    """Streaming read of a topic as envelope rows; needs the Kafka connector on the classpath."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("failOnDataLoss", "false")
    )
    if min_partitions:
        reader = reader.option("minPartitions", str(min_partitions))
    return unpack_log(reader.load())


def unpack_log(raw: DataFrame) -> DataFrame:
    """Log records (key, value, topic, partition, offset, timestamp) to envelope rows."""
    return raw.select(
        F.col("value").cast("string").alias("payload_json"),
        F.col("offset").cast("long").alias("source_offset"),
        F.col("partition").cast("long").alias("source_partition"),
        F.col("topic").alias("source_topic"),
        F.col("timestamp").alias("kafka_ts"),
        F.col("key").cast("string").alias("kafka_key"),
        F.current_timestamp().alias("_ingested_at"),
    )


def stream_table(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None, **options: str
) -> DataFrame:
    """Follow a table folder, or one file of a folder, as a stream."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    if is_directory(spark, path):
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def publish_frame(
    df: DataFrame, ticker: str | Column, event_time: str | Column, columns: list[str]
) -> DataFrame:
    """Rows ready for a message log: keyed by ticker or INDEX, stamped with the event time."""
    return df.select(
        F.coalesce(F.nullif(as_col(ticker), F.lit("")), F.lit("INDEX")).alias("key"),
        F.to_json(F.struct(*columns)).alias("value"),
        as_col(event_time).cast("timestamp").alias("timestamp"),
    )


def publish(df: DataFrame, servers: str, topic: str) -> None:
    """Send ``publish_frame`` rows; needs the Kafka connector on the classpath."""
    (
        df.select("key", "value", "timestamp")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.retries", "5")
        .option("topic", topic)
        .save()
    )
