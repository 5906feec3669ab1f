"""Near-duplicates by SimHash fingerprints, searched with sharded BK-trees.

Fingerprints are 64 bits over shingles of words. The different ones are cut into
``radius + 2`` blocks of bits; two within the radius agree in two blocks at least, so they
meet in the shard of one pair of blocks. Every shard has a BK-tree. The trees go to the
tasks by a shuffle on the shard: together they grow with the corpus, so none is broadcast.
A shard above ``max_shard`` members is dealt again by one of five parts of its remaining
bits, of which two prints in reach have one in common. No pair is lost either way.

A shard passes on a spanning set of links; components of the whole are found by
alternating star contractions over stored tables.

Defined results: a null or blank text has fingerprint zero, linked like any other; a text
shorter than a shingle is one shingle; the component of a row is the smallest non-null id
that it reaches, null if there is none; repeated rows share a component; an empty table
gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.llm import bk_tree
from marketlake.llm.shared import in_arrow, small_join, stored

RADIUS = 4
SHINGLE = 4
SEED = 42
MAX_SHARD = 50_000
SLICE = 65_536


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of all shingles, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII space alone
    if not words:
        return 0
    size = min(size, len(words))
    whole = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(length + 1) - 1
    start = (stop - length)[: len(words) - size + 1]
    stop = stop[size - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(start), SLICE):
        cut = zip(start[at : at + SLICE].tolist(), stop[at : at + SLICE].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in cut], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def _print_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t, size) for t in batch.column("_text").to_pylist()], "<u8")
        columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view("<i8"))], [*names, "_print"])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE
) -> DataFrame:
    """Stored table: _id and _print of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_text"])
    schema = T.StructType([*schema.fields, T.StructField("_print", T.LongType())])
    return stored(in_arrow(rows, lambda b: _print_batches(b, size), schema), "fingerprints")


# --- shards -----------------------------------------------------------------------------


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _picked(prints: Column, bits: list[int]) -> Column:
    """The given bits as a number; runs of neighbouring bits are moved together."""
    out, at = F.lit(0).cast("long"), 0
    while at < len(bits):
        run = 1
        while at + run < len(bits) and bits[at + run] == bits[at] + run:
            run += 1
        moved = F.shiftrightunsigned(prints, bits[at]).bitwiseAND(F.lit((1 << run) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(moved, at))
        at += run
    return out


def shard_rows(
    prints: DataFrame, radius: int, max_shard: int = MAX_SHARD, asked: str | None = None, narrow: int = 500_000
) -> DataFrame:
    """Each row with the key of every shard that its print belongs to: _shard, _print and the
    other columns. With ``asked``, shards in which that column is never true are left out; up to
    ``narrow`` that stay are broadcast.
    """
    own = prints.columns
    blocks = _blocks(list(range(64)), radius + 2)
    pairs = list(combinations(range(len(blocks)), 2))
    width = 2 * max(map(len, blocks))
    p = F.col("_print")
    fixed = [blocks[a] + blocks[b] for a, b in pairs]
    keys = [_picked(p, bits) + F.lit(i << width).cast("long") for i, bits in enumerate(fixed)]
    dealt = prints.select(F.explode(F.array(*keys)).alias("_shard"), *own)
    if asked:
        wanted = dealt.filter(asked).select("_shard").distinct()
        dealt = small_join(dealt, wanted, ["_shard"], "left_semi", narrow)
    large = stored(
        dealt.groupBy("_shard").count().filter(F.col("count") > max_shard).select("_shard"), "shards"
    )
    if large.isEmpty():
        return dealt
    finer = None
    split = dealt.join(large, "_shard", "left_semi")
    for i, bits in reversed(list(enumerate(fixed))):
        rest = _blocks([b for b in range(64) if b not in bits], radius + 1)
        room = max(map(len, rest))
        parts = F.array(
            *[
                F.shiftleft("_shard", room + 3) + F.lit(k << room).cast("long") + _picked(p, part)
                for k, part in enumerate(rest)
            ]
        )
        mine = F.shiftright("_shard", width) == i
        finer = parts if finer is None else F.when(mine, parts).otherwise(finer)
    # negative, so that no finer key meets a plain one
    again = split.select(F.explode(F.transform(finer, lambda key: -key - 1)).alias("_shard"), *own)
    return dealt.join(large, "_shard", "left_anti").unionByName(again)


def first_meeting(shard: np.ndarray, one: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Whether each shard is the first of all shards of ``shard_rows`` in which two prints meet."""

    def mask(bits: list[int]) -> np.uint64:
        return np.uint64(sum(1 << b for b in bits))

    def first(masks: list[np.uint64], apart: np.ndarray) -> np.ndarray:
        found = np.full(len(apart), len(masks))
        for k in reversed(range(len(masks))):
            found[(apart & masks[k]) == 0] = k
        return found

    blocks = _blocks(list(range(64)), radius + 2)
    width = 2 * max(map(len, blocks))
    fixed = [a + b for a, b in combinations(blocks, 2)]
    rests = [_blocks([b for b in range(64) if b not in bits], radius + 1) for bits in fixed]
    room = max(len(part) for rest in rests for part in rest)
    apart, finer = one ^ other, shard < 0
    key = np.where(finer, -shard - 1, shard)
    pair = np.where(finer, key >> (room + 3 + width), key >> width)
    good = first([mask(bits) for bits in fixed], apart) == pair
    for i in np.unique(pair[finer & good]):
        some = np.flatnonzero(finer & good & (pair == i))
        good[some] = first([mask(part) for part in rests[i]], apart[some]) == (key[some] >> room) & 7
    return good


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    got = [(b.column("_shard").to_numpy(), b.column("_print").to_numpy()) for b in batches]
    if not got:
        return
    shard = np.concatenate([g[0] for g in got])
    prints = np.concatenate([g[1] for g in got]).view("<u8")
    one, other = bk_tree.spanning(shard, prints, radius)
    for at in range(0, len(one), SLICE):
        cut = slice(at, at + SLICE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(one[cut].view("<i8")), pa.array(other[cut].view("<i8"))], ["_a", "_b"]
        )


def links(prints: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links between different prints that connect all that are within the radius."""
    rows = shard_rows(prints, radius, max_shard).repartition("_shard")
    found = in_arrow(rows, lambda b: _search(b, radius), "_a long, _b long")
    return found.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct()


# --- components ---------------------------------------------------------------------------


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("_a", "_b"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of the edges (_a > _b) reaches: _node, _label.

    A large star hangs the greater neighbours of a node on its least one, a small star the
    lesser ones; repeated, every component becomes one star around its least node. Least
    neighbours are stored before they are joined, so that the joins are plain ones in which
    Spark can split the edges of a node with very many.
    """
    edges = stored(edges, "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.least(F.min("_b"), F.min("_a")).alias("_least"))
        least = stored(least, "least")
        large = stored(
            both.join(least, "_a")
            .filter("_b > _a AND _b != _least")
            .select(F.col("_b").alias("_a"), F.col("_least").alias("_b"))
            .distinct(),
            "stars",
        )
        least = stored(large.groupBy("_a").agg(F.min("_b").alias("_least")), "least")
        small = large.join(least, "_a").select(
            F.explode(
                F.array(
                    F.struct(F.col("_b").alias("_a"), F.col("_least").alias("_b")),
                    F.struct(F.col("_a"), F.col("_least").alias("_b")),
                )
            ).alias("_e")
        )
        edges = stored(small.select("_e.*").filter("_a != _b").distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_label"))


def _labelled(printed: DataFrame, radius: int, max_shard: int) -> DataFrame:
    """Each different print with the label of its component and that component's least id."""
    prints = stored(printed.groupBy("_print").agg(F.min("_id").alias("_first")), "prints")
    found = connected(links(prints.select("_print"), radius, max_shard))
    named = prints.join(found, F.col("_print") == F.col("_node"), "left").select(
        "_print", "_first", F.coalesce("_label", "_print").alias("_label")
    )
    named = stored(named, "labels")
    # stored, so that the join may split the prints of a very large component
    least = stored(named.groupBy("_label").agg(F.min("_first").alias("_least")), "least_ids")
    return named.join(least, "_label")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    radius: int = RADIUS,
    max_shard: int = MAX_SHARD,
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id."""
    printed = fingerprints(docs, id_col, text_col, size)
    labelled = _labelled(printed, radius, max_shard)
    return printed.join(labelled.select("_print", "_least"), "_print").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )

