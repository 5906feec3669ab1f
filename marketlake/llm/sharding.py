"""Contiguous shards of near equal bytes, by prefix sums over the whole table.

Rows are put in id order by range partitions and written once. Of each partition come its
rows and bytes; the running totals of these few numbers give every partition its place in
the whole. Inside, running sums go on from there. A row belongs to the shard in which the
middle of its bytes lies, so shards are contiguous and each bound is at most half a row
off its target.

Defined results: a null text has size 1 and the checksum of nothing; null ids come first;
rows with equal ids are in order of their checksum; repeated rows have slots of their own;
an empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.shared import small_join, stored, whole

SHARDS = 8


def placed(
    docs: DataFrame, size: Column, checksum: Column, shards: int = SHARDS, id_col: str = "doc_id"
) -> DataFrame:
    """id, size, checksum, shard and slot (from 0 in each shard) of every row."""
    order = [F.col("_id").asc_nulls_first(), F.col("_crc"), F.col("_tie")]
    rows = docs.select(F.col(id_col).alias("_id"), size.alias("_size"), checksum.alias("_crc"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    part = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    part = stored(part, "ranges")

    # totals of partitions: as many rows as there are partitions, whatever the table holds
    totals = part.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    summed = small_join(part, offsets, ["_part"]).select(
        "_id",
        "_size",
        "_crc",
        (F.col("_bytes_before") + F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("_end"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_row"),
        "_total",
    )
    # twice the middle of the row, against twice the total: no fractions
    middle = 2 * F.col("_end") - F.col("_size")
    shard = F.least(
        F.floor(middle * shards / (2 * F.col("_total"))).cast("int"), F.lit(shards - 1)
    )
    summed = stored(summed.withColumn("shard", shard), "sharded")
    first = summed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return small_join(summed, first, ["shard"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("checksum"),
        "shard",
        (F.col("_row") - F.col("_first")).alias("slot"),
    )


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shards by the bytes of the text plus one for the end of the document."""
    text = whole(text_col)
    return placed(docs, F.octet_length(text).cast("long") + 1, F.crc32(text), shards, id_col)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole rows to one folder a shard, in slot order. Ids must be unique here."""
    where = shard_documents(docs, shards, id_col, text_col).select(id_col, "shard", "slot")
    rows = docs.join(where, id_col)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
