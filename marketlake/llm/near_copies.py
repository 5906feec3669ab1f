"""Near copies by SimHash and BK-trees, confirmed by the similarity of their shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of
0.8 or more. A row goes if such a copy of it has a smaller id, so of any two near copies
that are found at most one stays.

Changing one word changes five shingles, so fingerprints of shingles lie far apart long
before the similarity falls to 0.8. The fingerprint that finds candidates is therefore
taken over the different words of a text. It is searched as ``simhash`` does, in shards of
BK-trees dealt by pairs of bit blocks; see there for why no pair in reach is lost. What is
in reach must also have numbers of shingles that allow the similarity, a second
fingerprint, of other hashes, within ``CHECK_RADIUS``, and parities that allow it.

Parities are ``PARITIES`` bits of the set of shingles: each bit tells whether an odd number
of them hash to it. Bits that differ are never more than shingles in one set alone, so what
this drops is not similar, whatever the hashes. Texts that share their words and most of
their sentences are thus told apart where they meet, before a pair is passed on.

Families of thousands of copies are no reason to look at all their pairs. In the first
round every row is compared with one earlier row near it. Rows that go are out; only rows
that found nothing similar although their search ended early are searched again, for eight
times as many candidates, among all rows that are left. Rounds end when no search of a
staying row ended early. A pair of staying rows within the radius has then been compared.
Two prints meet in up to 28 shards; the first of these alone passes the pair on.

Defined results: null and blank texts have fingerprint zero and no shingle, and are copies
of each other; a text shorter than a shingle is one shingle; null ids come last, rows with
equal ids are ordered by their place in the input; a text of any length is hashed in slices (64 bits a
shingle); an empty table gives no rows; columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.llm import bk_tree
from marketlake.llm.shared import in_arrow, small_join, stored
from marketlake.llm.simhash import MAX_SHARD, SEED, SLICE, first_meeting, shard_rows

RADIUS = 6
SHINGLE = 5
SIMILARITY = 0.8
CHECK_RADIUS = 10
PARITIES = 256
ODD = [f"_odd{i}" for i in range(PARITIES // 64)]
FIRST, MORE = 1, 8  # candidates of a row in the first round, and the growth from there
NARROW = 500_000  # rows of one number that may be broadcast


def _digests(words: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    hashes = b"".join([xxhash.xxh128_digest(w, SEED) for w in words])
    return np.frombuffer(hashes, "<u8").reshape(-1, 2)


def word_prints(text: str | None) -> list[int]:
    """Bits set in over half of the hashes of the different words, for two hashes."""
    return _majority(_digests(list(set((text or "").encode().lower().split()))))


def _majority(hashes: np.ndarray) -> list[int]:
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").tolist()


def features(text: str | None, size: int = SHINGLE) -> tuple[list[int], int, np.ndarray]:
    """Prints of the words, number of different shingles, and their parities as numbers.

    A shingle is hashed from the hashes of its words in their order.
    """
    words = (text or "").encode().lower().split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    hashes = _digests(list(number))
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1 if words else 0, np.uint64)
    own = hashes[np.fromiter(map(number.__getitem__, words), np.int64, len(words)), 0]
    for i in range(size):
        runs = (runs ^ own[i : i + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    runs = np.unique(runs * np.uint64(0xBF58476D1CE4E5B9))
    odd = np.bincount((runs >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return _majority(hashes), len(runs), np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    found = [np.zeros(0, np.uint64)]
    for at in range(0, len(words) - size + 1 if words else 0, SLICE):
        cut = words[at : at + SLICE + size - 1]
        runs = [b" ".join(cut[i : i + size]) for i in range(len(cut) - size + 1)]
        found.append(np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], np.uint64))
    return np.unique(np.concatenate(found))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _print_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [features(t, size) for t in batch.column("_text").to_pylist()]
        prints = np.array([g[0] for g in got], "<u8").view("<i8").reshape(-1, 2)
        odd = np.array([g[2] for g in got], "<i8").reshape(-1, len(ODD))
        rest = batch.drop_columns(["_text"]).append_column("_print", pa.array(prints[:, 0]))
        rest = rest.append_column("_check", pa.array(prints[:, 1]))
        rest = rest.append_column("_size", pa.array([g[1] for g in got], pa.int64()))
        for k, name in enumerate(ODD):
            rest = rest.append_column(name, pa.array(np.ascontiguousarray(odd[:, k])))
        yield rest


# --- candidates --------------------------------------------------------------------------


def _search(
    batches: Iterator[pa.RecordBatch], radius: int, most: int, similarity: float
) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    if not got:
        return
    table = pa.Table.from_batches(got)
    order = [(c, "ascending") for c in ("_shard", "_id", "_key")]
    table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_end"))
    shard, prints, key, asked = (table.column(c).to_numpy() for c in ("_shard", "_print", "_key", "_open"))
    prints = prints.view("<u8")
    check, size = table.column("_check").to_numpy().view("<u8"), table.column("_size").to_numpy()
    odd = [table.column(c).to_numpy().view("<u8") for c in ODD if c in table.column_names]

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        good = (low >= similarity * high) & (bk_tree.distance(check[i], check[j]) <= CHECK_RADIUS)
        some = np.flatnonzero(good) if odd else np.zeros(0, np.int64)
        one, other = i[some], j[some]
        apart = sum((bk_tree.distance(o[one], o[other]) for o in odd), np.zeros(len(some), np.int64))
        # shingles of one text alone are at most this share of both texts' numbers of them
        good[some] = apart * (1 + similarity) <= (1 - similarity) * (size[one] + size[other]) + 1e-6
        return good

    forest = bk_tree.Forest(shard, prints, keep=False)
    hits = np.zeros(len(key), np.int64)
    told = np.zeros(len(key), bool)
    for i, j in forest.earlier(radius, most, asked, fits):
        np.add.at(hits, i, 1)
        mine = first_meeting(shard[i], prints[i], prints[j], radius)
        i, j = i[mine], j[mine]
        told[i] |= hits[i] >= most
        for at in range(0, len(i), SLICE):
            cut = slice(at, at + SLICE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[i[cut]]), pa.array(key[j[cut]]), pa.array(told[i[cut]])], ["_x", "_y", "_ended"]
            )
    # with one hit asked for, the first shard in which a row has any tells that it ended
    ended = key[(hits >= most) & ~told] if most > 1 else key[:0]
    for at in range(0, len(ended), SLICE):
        some = ended[at : at + SLICE]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.nulls(len(some), pa.int64()), pa.array(np.ones(len(some), bool))],
            ["_x", "_y", "_ended"],
        )


def candidates(rows: DataFrame, radius: int, most: int, max_shard: int, similarity: float) -> DataFrame:
    """For each open row, at most ``most`` earlier keys near it as _ys, and whether there may
    be more as _ended. ``rows`` has _key, _id, _print, _check, _size, the parities and _open.
    """
    own = rows.select("_print", "_key", "_id", "_check", "_size", *ODD, "_open")
    # all are asked in the first round, later few are
    dealt = shard_rows(own, radius, max_shard, None if most == FIRST else "_open", NARROW).repartition("_shard")
    found = in_arrow(dealt, lambda b: _search(b, radius, most, similarity), "_x long, _y long, _ended boolean")
    # a row has at most a few hits from each of its shards
    each = found.groupBy("_x").agg(F.collect_set("_y").alias("_ys"), F.bool_or("_ended").alias("_ended"))
    first = F.slice(F.sort_array("_ys"), 1, most)
    return each.select("_x", first.alias("_ys"), (F.col("_ended") | (F.size("_ys") > most)).alias("_ended"))


def _compare(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    last, known = None, None
    for batch in batches:
        x, y, one, other = batch.columns
        kept = []
        for i in range(batch.num_rows):
            if y[i] != last:
                last, known = y[i], shingles(other[i].as_py(), size)
            if similar(shingles(one[i].as_py(), size), known, similarity):
                kept.append(i)
        yield pa.RecordBatch.from_arrays([x.take(pa.array(kept, pa.int64()))], ["_key"])


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The different _x of the pairs (_x, _y) whose texts are near copies, as _key."""
    pairs = stored(pairs, "pairs")
    used = pairs.select(F.col("_x").alias("_key")).union(pairs.select("_y")).distinct()
    needed = stored(small_join(texts, used, ["_key"], "left_semi", NARROW), "texts")
    one = needed.select(F.col("_key").alias("_x"), F.col("_text").alias("_one"))
    other = needed.select(F.col("_key").alias("_y"), F.col("_text").alias("_other"))
    both = pairs.join(one, "_x").join(other, "_y").select("_x", "_y", "_one", "_other")
    return in_arrow(both, lambda b: _compare(b, size, similarity), "_key long").distinct()


def survivors(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    max_shard: int = MAX_SHARD,
) -> DataFrame:
    """The rows of ``docs`` that have no near copy of smaller id, all columns."""
    number = F.monotonically_increasing_id()  # stored, so that it stays the same
    rows = stored(docs.select(F.struct(*docs.columns).alias("_row"), number.alias("_key")), "rows")
    text = rows.select("_key", F.col(f"_row.{text_col}").alias("_text"))
    told = rows.select("_key", F.col(f"_row.{id_col}").alias("_id"), F.col(f"_row.{text_col}").alias("_text"))
    numbers = [T.StructField(c, T.LongType()) for c in ("_print", "_check", "_size", *ODD)]
    schema = T.StructType([told.schema["_key"], told.schema["_id"], *numbers])
    prints = stored(in_arrow(told, lambda b: _print_batches(b, size), schema), "prints")

    # one row of each print is searched, the others are compared with it
    place = F.struct(F.col("_id").isNull().alias("_last"), "_id", "_key", "_check", "_size", *ODD)
    first = stored(prints.groupBy("_print").agg(F.min(place).alias("_first")), "first_of_print")
    one = first.select("_print", F.col("_first._key").alias("_first"))
    alike = prints.join(one, "_print").filter("_key != _first")
    reps = first.select("_print", "_first.*", F.lit(True).alias("_open")).drop("_last")
    near = stored(candidates(reps, radius, FIRST, max_shard, similarity), "candidates")
    pairs = near.select("_x", F.explode("_ys").alias("_y"))
    pairs = pairs.unionByName(alike.select(F.col("_key").alias("_x"), F.col("_first").alias("_y")))
    gone = [stored(confirmed(pairs, text, size, similarity), "copies")]
    unsure = alike.select("_key").unionByName(near.filter("_ended").select(F.col("_x").alias("_key")))
    most = FIRST
    while True:
        out = reduce(DataFrame.unionByName, gone)
        unsure = stored(unsure.join(out, "_key", "left_anti"), "unsure")
        if unsure.isEmpty():
            break
        most *= MORE
        left = prints.join(out, "_key", "left_anti")
        marked = left.join(unsure.withColumn("_open", F.lit(True)), "_key", "left")
        asked = marked.withColumn("_open", F.coalesce("_open", F.lit(False)))
        near = stored(candidates(asked, radius, most, max_shard, similarity), "candidates")
        pairs = near.select("_x", F.explode("_ys").alias("_y"))
        gone.append(stored(confirmed(pairs, text, size, similarity), "copies"))
        unsure = near.filter("_ended").select(F.col("_x").alias("_key"))
    return small_join(rows, out, ["_key"], "left_anti", NARROW).select("_row.*")
