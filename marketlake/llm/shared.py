"""What the text operators share: reading, whole texts, stored tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake import storage

ASCII_SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole(text: str | Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The rows then survive lost executors, and steps that use them several times
    do not compute them again.
    """
    path = storage.work_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words between ASCII white space, as an array; none for a blank text."""
    body = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(
        F.split(body, f"{ASCII_SPACE}+")
    )


def small_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str] | Column,
    how: str = "inner",
    limit: int = 20_000,
) -> DataFrame:
    """Join with a table of narrow rows that is expected to be small, after counting it.

    Up to ``limit`` rows it is broadcast, so ``left`` is not shuffled; beyond that both
    sides are joined as Spark sees fit.
    """
    table = stored(right, "small")
    size = table.count()
    return left.join(F.broadcast(table) if size <= limit else table, on, how)


def winning_rows(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows named by ``winners``, one for each, with their own columns.

    ``rows`` has _row (struct of all columns), _id and _mark; ``winners`` has the _keep id
    and the _kept_mark of the row that stays. Ids are near unique, so a large group of
    copies is spread over all tasks. Where rows repeat both, the first by hash stays.
    """
    same = F.col("_mark") == F.col("_kept_mark")
    known = rows.join(winners, (F.col("_id") == F.col("_keep")) & same)
    unknown = rows.filter("_id IS NULL").join(winners.filter("_keep IS NULL"), same)
    place = Window.partitionBy("_id", "_mark").orderBy(F.xxhash64("_row"))
    placed = known.unionByName(unknown).withColumn("_place", F.row_number().over(place))
    return placed.filter("_place = 1").select("_row.*")


SLICE_ROWS = 1_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _prepare(spark: SparkSession) -> None:
    """Let workers find this package where the driver has it, and end batches at 4 MB.

    On a cluster without the package at that path, install it or send it with ``--py-files``.
    Spark reads the size of batches from the session when a query runs, so it is set there,
    unless the session has one of its own in place of Spark's 64 MB.
    """
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(BATCH_BYTES, "4m")
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spark ends a batch by its bytes, however long its texts; slices keep the Python objects
    made from many short texts few as well.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with workers that find this package and see batches in slices."""
    _prepare(df.sparkSession)
    return df.mapInArrow(lambda batches: run(_slices(batches)), schema)


def group_in_arrow(df: DataFrame, keys: list[str], run: Callable, schema) -> DataFrame:
    """``applyInArrow`` with workers that find this package; for groups of bounded size."""
    _prepare(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)
