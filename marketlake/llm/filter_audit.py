"""How filters that run one after another share what they remove.

Five filters judge every text: A under 200 words, B few distinct words, C many capitals,
D a symbol, E equal to the text of a smaller id. What each removes in each order follows
from how many documents fail which set of them, 32 counts per part.

E needs equal texts to meet. A counting Bloom sketch of text hashes clears most texts
first: every task counts the cells that its hashes hit, up to two, the counts of all tasks
are merged slice by slice, and a text one of whose cells was hit once has no equal. Only
the others are shuffled, by their full text, for the smallest id. Copies found so are
joined to their smallest id and moved, in the counts, from their set to the one with E.

The merged sketch has at most ``MAX_CELLS`` bits (32 MB) and is broadcast. With more texts
than that serves, it clears fewer of them and more are shuffled; results stay exact.

Defined results: a null text is empty (no words, so A fails); a null part is the empty
one; a null id has no label, fails E never and makes no other text fail it; repeated rows
count each, and rows with the same id and text do not fail E through each other; of
several labels of one id any that is 1 counts; a text of any length is read in slices; an
empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from marketlake.llm.shared import group_in_arrow, in_arrow, stored, whole

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3

CELLS_PER_TEXT, HASHES = 8, 4
MAX_CELLS = 1 << 28
SLICE = 1 << 16
KEYS_AT_ONCE = 1 << 20

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no character
LONG = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


# --- filters A to D ----------------------------------------------------------------------


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space."""
    at = 0
    while len(text) - at > LONG:
        cut = SPACE.search(text, at + LONG)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails; A is bit 0."""
    n, distinct = 0, set()
    for part in _slices(text):
        words = part.split()  # of bytes: at ASCII white space only
        n += len(words)
        distinct.update(words)
    length = len(text)
    upper = length - len(text.translate(None, UPPER))
    points = len(text.translate(None, FOLLOWING))
    return (
        (n < MIN_WORDS)
        | (100 * len(distinct) < MIN_DISTINCT_PERCENT * n) << 1
        | (100 * upper > MAX_UPPER_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < length) << 3
    )


def _mask_batches(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        texts = batch.column(at).cast(pa.binary())
        bits = pa.array([failed(t.as_py()) for t in texts], pa.int32())
        rest = batch if keep_text else batch.drop_columns(["_text"])
        yield rest.append_column("_mask", bits)


def with_mask(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """Add _mask, the failed filters among A to D, and leave _text out unless it is kept."""
    fields = [f for f in rows.schema.fields if keep_text or f.name != "_text"]
    schema = StructType(fields).add("_mask", IntegerType())
    return in_arrow(rows, lambda b: _mask_batches(b, keep_text), schema)


# --- the counting sketch -----------------------------------------------------------------


def sketch_size(texts: int, max_cells: int = MAX_CELLS) -> tuple[int, int]:
    """Cells (a power of two) and hashes for so many texts."""
    wanted = max(SLICE, CELLS_PER_TEXT * texts)
    cells = min(1 << (wanted - 1).bit_length(), max_cells)
    return cells, HASHES if cells >= wanted else max(1, min(HASHES, cells // max(texts, 1)))


def cells_of(keys: np.ndarray, cells: int, hashes: int) -> np.ndarray:
    """One row of distinct cells for each 64-bit key."""
    keys = keys.astype(np.int64).view(np.uint64)
    first, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    turns = np.arange(hashes, dtype=np.uint64)
    return ((first[:, None] + turns * step[:, None]) & np.uint64(cells - 1)).astype(np.int64)


def _slices_hit(keys: np.ndarray, cells: int, hashes: int) -> pa.RecordBatch:
    """For each slice with hits: the cells hit, and those hit twice or more."""
    hit, times = np.unique(cells_of(keys, cells, hashes), return_counts=True)
    numbers, starts = np.unique(hit // SLICE, return_index=True)
    offsets, twice = (hit % SLICE).astype("<u2"), times > 1
    parts = list(zip(starts, [*starts[1:], len(hit)], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(numbers, pa.int32()),
            pa.array([offsets[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([offsets[a:b][twice[a:b]].tobytes() for a, b in parts], pa.binary()),
        ],
        ["slice", "hit", "twice"],
    )


def _count_batches(batches: Iterator[pa.RecordBatch], cells: int, hashes: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= KEYS_AT_ONCE:
            yield _slices_hit(np.concatenate(held), cells, hashes)
            held, n = [], 0
    if n:
        yield _slices_hit(np.concatenate(held), cells, hashes)


def _merge_slice(table: pa.Table) -> pa.Table:
    """The counts of all tasks added up to two; the cells with two as bits."""
    counts = np.zeros(SLICE, np.uint8)
    for hit, twice in zip(table.column("hit"), table.column("twice"), strict=True):
        offsets = np.frombuffer(hit.as_py(), "<u2")
        counts[offsets] = np.minimum(counts[offsets] + 1, 2)
        counts[np.frombuffer(twice.as_py(), "<u2")] = 2
    bits = np.packbits(counts > 1, bitorder="little").tobytes()
    return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([bits], pa.binary())})


def repeated_cells(keys: DataFrame, cells: int, hashes: int) -> np.ndarray:
    """Bits of the cells that the keys of the one column hit twice or more."""
    hits = in_arrow(keys, lambda b: _count_batches(b, cells, hashes), "slice int, hit binary, twice binary")
    merged = group_in_arrow(hits, ["slice"], _merge_slice, "slice int, bits binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.collect():  # at most MAX_CELLS bits
        at = row["slice"] * (SLICE // 8)
        bits[at : at + SLICE // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def possible_repeat(keys: np.ndarray, bits: np.ndarray, hashes: int) -> np.ndarray:
    """False where a key has a cell that was hit once, so that no other key equals it."""
    hit = cells_of(keys, len(bits) * 8, hashes)
    return ((bits[hit >> 3] >> (hit & 7).astype(np.uint8)) & 1).all(axis=1)


def maybe_repeated(rows: DataFrame, keys: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows whose _text the sketch cannot clear; ``keys`` has the hash of every text."""
    cells, hashes = sketch_size(keys.count(), max_cells)
    shared = rows.sparkSession.sparkContext.broadcast(repeated_cells(keys, cells, hashes))

    @F.pandas_udf("boolean")
    def uncleared(key: pd.Series) -> pd.Series:
        return pd.Series(possible_repeat(key.to_numpy(), shared.value, hashes))

    return rows.filter(uncleared(F.xxhash64("_text")))


# --- counts ------------------------------------------------------------------------------


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones by _part and _mask."""
    alike = rows.groupBy("_id", "_part", "_mask").agg(F.count(F.lit(1)).alias("_n"))
    known = alike.join(labels, "_id", "left")
    return known.groupBy("_part", "_mask").agg(
        F.sum("_n").alias("_n"),
        F.sum(F.when(F.col("_good"), F.col("_n")).otherwise(0)).alias("_good"),
        F.sum(F.when(F.col("_toxic"), F.col("_n")).otherwise(0)).alias("_toxic"),
    )


def _moved(later: DataFrame, bit: int) -> DataFrame:
    """Counts to add: each set of ``later`` gains the bit, and the set without it loses."""
    gain = later.withColumn("_mask", F.col("_mask").bitwiseOR(F.lit(bit)))
    return gain.unionByName(later.select("_part", "_mask", *[(-F.col(c)).alias(c) for c in ("_n", "_good", "_toxic")]))


def _steps() -> Column:
    """All orders and steps: the filter of the step as a bit, and those before it."""
    found = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for step, filter_no in enumerate(order, 1):
            name = "".join(LETTERS[i] for i in order)
            found.append((name, step, 1 << filter_no, before))
            before |= 1 << filter_no
    names = ("filter_order", "step", "bit", "before")
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, row, strict=True)]) for row in found])


def _total(counts: str, fits) -> Column:
    """Sum of the counts of the sets that fit."""
    sets = F.sequence(F.lit(0), F.lit((1 << len(LETTERS)) - 1))
    start = F.lit(0).cast("long")
    return F.aggregate(sets, start, lambda total, s: total + F.when(fits(s), F.get(F.col(counts), s)).otherwise(start))


def interactions(counts: DataFrame) -> DataFrame:
    """Every order and step for each _part, from counts by _part and _mask."""
    sets = range(1 << len(LETTERS))
    by_set = lambda c: F.array(*[F.sum(F.when(F.col("_mask") == s, F.col(c)).otherwise(0)) for s in sets])
    parts = counts.groupBy("_part").agg(*[by_set(c).alias(c) for c in ("_n", "_good", "_toxic")])
    rows = parts.withColumn("_at", F.explode(_steps())).select("*", "_at.*")
    bit, before = F.col("bit"), F.col("before")
    fails = lambda s: s.bitwiseAND(bit) != 0
    gone = lambda s: s.bitwiseAND(before) != 0
    here = lambda s: fails(s) & ~gone(s)
    told = rows.select(
        F.col("_part").alias("part"),
        "filter_order",
        "step",
        "bit",
        _total("_n", lambda s: ~fails(s) & ~gone(s)).alias("kept"),
        _total("_n", here).alias("removed"),
        _total("_n", lambda s: fails(s) & gone(s)).alias("redundant"),
        _total("_n", lambda s: s == bit).alias("unique_fails"),
        _total("_good", here).alias("good_lost"),
        _total("_toxic", here).alias("toxic_lost"),
    )
    over_orders = told.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return told.join(over_orders, ["part", "bit"]).drop("bit")


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """One row per part, order of the filters and step."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"),
        whole(text_col).alias("_text"),
    )
    seen = stored(with_mask(rows.withColumn("_key", F.xxhash64("_text"))), "masks")
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(quality_col) == 1).alias("_good"), F.max(F.col(toxic_col) == 1).alias("_toxic")
    )
    maybe = maybe_repeated(rows, seen.select("_key"), max_cells)
    ids = maybe.groupBy("_text").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    # stored, so that the join may split the rows of a text with very many copies
    first = stored(with_mask(ids.filter("_last > _first"), keep_text=True), "first_ids")
    later = maybe.join(first, "_text").filter("_id > _first").select("_id", "_part", "_mask")
    moved = _moved(stored(_labelled(later, known), "later_copies"), 1 << LETTERS.index("E"))
    return interactions(_labelled(seen, known).unionByName(moved))
