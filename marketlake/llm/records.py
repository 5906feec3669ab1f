"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A data file is a run of records in ascending id order. Files follow each other by the task in
their name and, within a task, by the number of their folder; a task begins a new file once
one holds ``FILE_BYTES``, so only a single longer record makes a larger one. Everything is
little-endian:

    8 bytes  length of the body
    4 bytes  masked checksum of these 8 bytes
    body     8 bytes id, 1 byte flags (1: the id is null), 1 byte width of a token id (2 or 4),
             then the token ids
    4 bytes  masked checksum of the body
    1 byte   line feed, the end of the record

A checksum is CRC-32 turned right by 15 bits plus a constant, so that data that hold
checksums do not check themselves. The line feed is what Spark's text writer ends a row
with; that writer commits files on any file system and survives lost tasks. The index is
a Parquet table beside the data: file, number in the file, offset, size, id, tokens.

Defined results: a null text is an empty one, so its record has the end id alone; null ids
come first; repeated rows are records of their own; an empty table gives no records; other
columns are never looked at. A damaged record raises. Very long texts are records like any
other; a file, and with it what one task holds to read it, is bounded by bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlake.llm.shared import in_arrow, small_join
from marketlake.llm.tokens import encoder

# Fixed value: the constant of masked checksums in record files.
MASK = 0xA282EAD8
HEAD, SUM, BODY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
END_ID = 0
FILE_BYTES = 32 << 20
REMEMBERED = 500_000  # words a worker keeps with their ids
DAMAGED = "damaged record"

INDEX = "path string, record long, offset long, size long, id long, n_tokens long, before long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(key: int | None, ids: bytes) -> bytes:
    """One record without its line feed; ``ids`` are 32-bit numbers and take 16 bits each
    where all of them fit.
    """
    numbers = np.frombuffer(ids, "<u4")
    narrow = not len(numbers) or int(numbers.max()) < 1 << 16
    body = BODY.pack(key or 0, key is None, 2 if narrow else 4)
    body += numbers.astype("<u2").tobytes() if narrow else ids
    head = HEAD.pack(len(body))
    return b"".join([head, SUM.pack(masked(head)), body, SUM.pack(masked(body))])


def unframe(data: memoryview, at: int) -> tuple[int, int | None, np.ndarray]:
    """Record at an offset: its size, id and token ids."""
    head = data[at : at + HEAD.size]
    body_at = at + HEAD.size + SUM.size
    if len(data) < body_at or SUM.unpack_from(data, at + HEAD.size)[0] != masked(head):
        raise ValueError(f"{DAMAGED}: length at {at}")
    stop = body_at + HEAD.unpack(head)[0]
    body = data[body_at:stop]
    if len(data) < stop + SUM.size + 1 or SUM.unpack_from(data, stop)[0] != masked(body):
        raise ValueError(f"{DAMAGED}: body at {at}")
    key, null, width = BODY.unpack_from(body)
    ids = np.frombuffer(body, "<u2" if width == 2 else "<u4", offset=BODY.size)
    return stop + SUM.size + 1 - at, None if null else key, ids


# --- writing ------------------------------------------------------------------------------


def _frame_batches(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, file_bytes: int
) -> Iterator[pa.RecordBatch]:
    tokenizer = encoder(path, REMEMBERED)
    end = np.array([end_id], "<u4").tobytes()
    place, file, held = 0, 0, 0
    for batch in batches:
        framed, files, places = [], [], []
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            framed.append(frame(key.as_py(), tokenizer.encode(text.as_py()) + end))
            if held >= file_bytes:
                file, held = file + 1, 0
            held += len(framed[-1]) + 1
            files.append(file)
            places.append(place)
            place += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(framed, pa.binary()), pa.array(files, pa.int32()), pa.array(places, pa.int64())],
            ["value", "file", "place"],
        )


def write_records(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Encode all texts and write ``path``/data and ``path``/index."""
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("_id"), F.col(text_col).alias("_text"))
    # equal ids may be many: the hash of the text lets them spread
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    framed = in_arrow(
        placed,
        lambda b: _frame_batches(b, tokenizer_path, end_id, file_bytes),
        "value binary, file int, place long",
    )
    # the writer needs the rows of a file together; the order within is stated to it as well
    ready = framed.sortWithinPartitions("file", "place").select(F.col("value").cast("string"), "file")
    ready.write.partitionBy("file").text(f"{path}/data")
    _index(docs.sparkSession, f"{path}/data").write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, bounded by bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "content")


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, at, before, rows = memoryview(content.as_buffer()), 0, 0, []
            while at < len(data):
                size, key, ids = unframe(data, at)
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                rows.append((name, len(rows), at, size, key, len(ids), before, crc))
                at, before = at + size, before + len(ids)
            kinds = [pa.string(), *[pa.int64()] * 7]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            names = [f.split()[0] for f in INDEX.split(", ")]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _index(spark: SparkSession, path: str) -> DataFrame:
    """Walk all files, checking every checksum."""
    return in_arrow(_files(spark, path), _index_batches, INDEX)


# --- reading ------------------------------------------------------------------------------


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``start``: ids of all records before, by the totals of earlier files."""
    index = spark.read.parquet(f"{path}/index")
    name = F.regexp_extract
    totals = index.groupBy("path").agg(F.sum("n_tokens").alias("_tokens"))
    # file=3/part-00012-...: number of the file in its task, and task
    order = Window.orderBy(
        name("path", r"part-(\d+)-[^/]*$", 1).cast("int"), name("path", r"/file=(\d+)/[^/]*$", 1).cast("int")
    ).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "path", F.coalesce(F.sum("_tokens").over(order), F.lit(0)).alias("_before")
    )
    return small_join(index, starts, ["path"]).withColumn("start", F.col("_before") + F.col("before"))


def _pick_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            data, rows = memoryview(content.as_buffer()), []
            for want in wanted:
                _, key, ids = unframe(data, want["offset"])
                rows.append((want["place"], key, ids.astype(np.int32)))
            places, keys, ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int64()), pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                ["place", "id", "ids"],
            )


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, share: float = 1.0) -> DataFrame:
    """Records in a random order fixed by ``seed``: place, id, ids; or a share of them.

    Rows come sorted by ``place``, a hash of the seed and the place in the files. A file
    that no chosen record is in is not decoded.
    """
    place = F.xxhash64(F.lit(seed), "path", "offset")
    index = spark.read.parquet(f"{path}/index").select("path", place.alias("place"), "offset")
    chosen = index.filter(F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    wanted = chosen.groupBy("path").agg(F.collect_list(F.struct("place", "offset")).alias("_wanted"))
    files = _files(spark, f"{path}/data").join(wanted, "path").select("content", "_wanted")
    return in_arrow(files, _pick_batches, "place long, id long, ids array<int>").orderBy("place")
