import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlake.llm import packing, queries, records, sharding, tokens

from .conftest import SCHEMA, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "LONG", 9)
    draw = random.Random(4)
    signs = ["a", "B", " ", " ", "\n", "\t", "'s", "é", "1", "23", "..", ",", "日本", "　", "\xa0", "\x1c", "<|endoftext|>", "!", "'", "²", "'ll", "word", "word."]
    own = tokens.Encoder(PATH, 50)
    for _ in range(5000):
        text = "".join(draw.choices(signs, k=draw.randint(0, 20)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(tokenizer, text, 0)[:-1], text
    other = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(other.encode("The End. two"), "<u4").tolist() == plain.encode("The End. two", add_special_tokens=False).ids


# --- packing -----------------------------------------------------------------------------


def test_pieces_and_places(odd, odd_rows, small, small_rows, none, tokenizer):
    for docs, pairs in ((odd, odd_rows), (small, small_rows)):
        rows = packing.pack(docs, PATH).collect()
        expected = Counter()
        for key, text in pairs:
            ids = ids_of(tokenizer, text, 2)
            for piece, (start, length) in enumerate(packing.cuts(len(ids), 1024)):
                expected[key, piece, start, length, crc(ids[start : start + length])] += 1
        assert Counter(tuple(r)[:5] for r in rows) == expected
        filled = defaultdict(list)
        for r in rows:
            filled[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(filled) <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 2
    assert packing.pack(none, PATH).count() == 0


def test_cuts_leave_only_the_first_short():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(3, 4) == [(0, 3)]


def test_sequences_hold_the_ids(small, small_rows, tokenizer):
    total = Counter()
    for row in packing.sequences(small, PATH).collect():
        ids = np.frombuffer(row["ids"], "<u4")
        assert len(ids) == row["n_tokens"] <= 1024
        total.update(ids.tolist())
    assert total == Counter(x for _, t in small_rows for x in ids_of(tokenizer, t, 2))


def test_search_empties_bins_that_best_fit_leaves():
    # best fit in descending order needs three bins here, two are enough
    bins = packing.Bins([6, 5, 4, 2, 2, 1], 10)
    bins.content, bins.fill = [[0, 3], [1, 2], [4, 5]], [8, 9, 3]
    before = sum(f * f for f in bins.fill)
    bins.search(1000)
    assert sum(f > 0 for f in bins.fill) == 2 and sum(f * f for f in bins.fill) > before
    assert sorted(p for c in bins.content for p in c) == list(range(6))


def test_search_never_makes_it_worse():
    draw = random.Random(1)
    for _ in range(30):
        lengths = [draw.randint(1, 60) for _ in range(draw.randint(1, 80))]
        plain = packing.Bins(lengths, 100)
        plain.best_fit()
        where, offset = packing.pack_lengths(lengths, 100)
        assert len(set(where)) <= len(plain.fill)
        by_bin = defaultdict(list)
        for p, b in enumerate(where):
            by_bin[b].append((offset[p], lengths[p]))
        for parts in by_bin.values():
            ends = [0, *[o + n for o, n in sorted(parts)]]
            assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100


def test_search_leaves_no_exchange():
    draw = random.Random(7)
    lengths = [draw.randint(300, 600) for _ in range(2000)]
    filled = defaultdict(list)
    for p, b in enumerate(packing.pack_lengths(lengths, 1024)[0]):
        filled[b].append(lengths[p])
    bins = sorted(filled.values(), key=sum)
    sums = [{x + y for i, x in enumerate(b) for y in b[:i]} for b in bins]
    rooms = [1024 - sum(b) for b in bins]
    for i in range(len(bins)):
        for j in range(i + 1, len(bins)):
            for gives, takes in ((bins[i], {0, *bins[j], *sums[j]}), (sums[i], bins[j])):
                assert not any(0 < g - t <= rooms[j] for g in gives for t in takes)


def test_repeated_rows_are_dealt_over_shards(spark):
    docs = spark.createDataFrame(rows_of([(None, "one and the same text")] * 2000), SCHEMA)
    rows = packing.place(packing.pieces(docs, PATH), shard_pieces=200).collect()
    sizes = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 2000 and len(sizes) == 10 and max(sizes.values()) < 300


# --- records -----------------------------------------------------------------------------


def test_round_trip(odd, odd_rows, none, spark, tokenizer, tmp_path):
    path = str(tmp_path / "records")
    records.write_records(odd, path, PATH, file_bytes=300)
    rows = records.read_index(spark, path).orderBy("start").collect()
    expected = [(key, ids_of(tokenizer, text, 0)) for key, text in odd_rows]
    assert Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((k, len(i), crc(i)) for k, i in expected)
    keys = [r["id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    shuffled = records.read_shuffled(spark, path, seed=1).collect()
    assert Counter((r["id"], tuple(r["ids"])) for r in shuffled) == Counter((k, tuple(i)) for k, i in expected)
    assert [r["place"] for r in shuffled] == sorted(r["place"] for r in shuffled)
    again = [r["place"] for r in records.read_shuffled(spark, path, seed=2).collect()]
    assert again != [r["place"] for r in shuffled]
    assert 0 < records.read_shuffled(spark, path, share=0.5).count() < len(rows)
    records.write_records(none, f"{path}-none", PATH)
    assert records.read_index(spark, f"{path}-none").count() == 0


def test_query_gives_places_in_id_order(spark, small_rows, tokenizer):
    rows = {r["doc_id"]: r for r in queries.op7_records(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for key, text in sorted(small_rows):
        ids = ids_of(tokenizer, text, 0)
        assert (rows[key]["start"], rows[key]["n_tokens"], rows[key]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_frames():
    wide = np.array([70_000, 5], "<u4").tobytes()
    for key, ids in ((7, wide), (None, b""), (-1, np.arange(9, dtype="<u4").tobytes())):
        data = records.frame(key, ids) + b"\n"
        size, found, back = records.unframe(memoryview(data), 0)
        assert (size, found, back.astype("<u4").tobytes()) == (len(data), key, ids)
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises(ValueError, match=records.DAMAGED):
            records.unframe(memoryview(bytes(broken)), 0)


# --- shards ------------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(odd, odd_rows, small, small_rows, none):
    for docs, pairs in ((odd, odd_rows), (small, small_rows)):
        rows = sharding.shard_documents(docs).collect()
        assert Counter((r["doc_id"], r["size"], r["checksum"]) for r in rows) == Counter(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs
        )
        order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
        assert keys == sorted(keys)
        for shard in {r["shard"] for r in rows}:
            assert [r["slot"] for r in order if r["shard"] == shard] == list(range(sum(r["shard"] == shard for r in rows)))
    sizes = Counter()
    for r in sharding.shard_documents(small).collect():
        sizes[r["shard"]] += r["size"]
    largest = max(len(t.encode()) + 1 for _, t in small_rows)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert sharding.shard_documents(none).count() == 0


def test_written_shards(spark, small, tmp_path):
    sharding.write_shards(small, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == small.count() and set(small.columns) <= set(back.columns)
    assert back.select("shard").distinct().count() == 4


def test_equal_rows_have_slots_of_their_own(spark):
    docs = spark.createDataFrame(rows_of([(1, "abc")] * 40), SCHEMA)
    rows = sharding.shard_documents(docs).groupBy("shard").agg(F.sum("size"), F.countDistinct("slot")).collect()
    assert sorted(tuple(r) for r in rows) == [(s, 20, 5) for s in range(8)]


def test_files_are_bounded_by_bytes_with_very_long_texts(spark, tmp_path):
    unit = "word and more words, " * 50
    texts = {i: unit * 10_000 for i in range(4)} | {i: unit for i in range(4, 60)}  # four of 10 MB
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    path = str(tmp_path / "long")
    records.write_records(docs.coalesce(1), path, PATH, file_bytes=1 << 20)
    sizes = [f.stat().st_size for f in Path(path, "data").rglob("part-*")]
    own = tokens.encoder(PATH)
    expected = {i: len(own.encode(t)) // 4 + 1 for i, t in texts.items()}
    assert max(sizes) < (1 << 20) + 2 * max(expected.values()) + 100
    assert len(sizes) >= 5
    rows = records.read_index(spark, path).orderBy("start").collect()
    assert [r["id"] for r in rows] == sorted(texts)
    assert {r["id"]: r["n_tokens"] for r in rows} == expected
