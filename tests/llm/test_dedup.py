import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlake.llm import bk_tree, exact_dedup, near_copies, simhash

from .conftest import SCHEMA, prose, rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_expected(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[(t or "").translate(LOWER)].append(i)
    out = Counter()
    for i, t in pairs:
        text = (t or "").translate(LOWER)
        known = [k for k in groups[text] if k is not None]
        keep = max(known) if known else None
        out[i, keep, len(groups[text]), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter(map(tuple, df.collect()))


def test_exact_members(odd, odd_rows, small, small_rows):
    assert got(exact_dedup.members(odd)) == exact_expected(odd_rows)
    assert got(exact_dedup.members(small)) == exact_expected(small_rows)


def test_exact_digest_shared_by_different_texts(small, small_rows):
    short = lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 7), 2, "0"))
    assert got(exact_dedup.members(small, digest=short)) == exact_expected(small_rows)


def test_exact_survivors(odd, odd_rows, none):
    kept = exact_dedup.survivors(odd)
    assert kept.columns == odd.columns
    texts = [(t or "").translate(LOWER) for _, t in odd_rows]
    rows = kept.collect()
    assert len(rows) == len(set(texts)) == len({(r["text"] or "").translate(LOWER) for r in rows})
    best = defaultdict(lambda: -1)
    for (i, _), text in zip(odd_rows, texts, strict=True):
        best[text] = max(best[text], -1 if i is None else i)
    assert all(best[(r["text"] or "").translate(LOWER)] == (-1 if r["doc_id"] is None else r["doc_id"]) for r in rows)
    assert exact_dedup.survivors(none).count() == exact_dedup.members(none).count() == 0


def test_survivors_of_ids_that_are_all_null(spark):
    docs = spark.createDataFrame(rows_of([(None, "a b"), (None, "A b"), (None, "c")]), SCHEMA)
    assert sorted(r["text"].lower() for r in exact_dedup.survivors(docs).collect()) == ["a b", "c"]
    assert near_copies.survivors(docs).count() == 2


def plain_fingerprint(text, size=4):
    words = (text or "").translate(LOWER)
    words = words.encode().split()
    if not words:
        return 0
    size = min(size, len(words))
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_expected(pairs, radius=4):
    prints = [plain_fingerprint(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(pairs):
        groups[find(i)].append(key)
    least = {g: min((k for k in ids if k is not None), default=None) for g, ids in groups.items()}
    return Counter((key, f"{prints[i]:016x}", least[find(i)]) for i, (key, _) in enumerate(pairs))


@pytest.mark.parametrize("max_shard", [50_000, 3])
def test_near_duplicates(odd, odd_rows, small, small_rows, max_shard):
    assert got(simhash.near_duplicates(odd, max_shard=max_shard)) == near_expected(odd_rows)
    assert got(simhash.near_duplicates(small, max_shard=max_shard)) == near_expected(small_rows)


def shingle_set(text, size=5):
    words = (text or "").translate(LOWER).encode().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def near_pairs(pairs, similarity=0.8):
    """Places of all near copies, the earlier first, by comparing all texts."""
    sets = [shingle_set(t) for _, t in pairs]
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0] is None, pairs[i][0] or 0, i))
    found = []
    for at, i in enumerate(order):
        for j in order[:at]:
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                found.append((j, i))
    return found


def families(seed=3, size=60):
    """Families of texts with a few words changed, some of them beyond a similarity of 0.8."""
    draw, rows = random.Random(seed), []
    for family in range(4):
        base = prose(draw, 150).split()
        for member in range(size):
            words = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 4]) if member else 0):
                words[draw.randrange(len(words))] = f"changed{draw.randrange(10**6)}"
            rows.append((1000 - len(rows) if family % 2 else 2000 + len(rows), " ".join(words) + f" end{len(rows)}"))
    return rows


@pytest.mark.parametrize("max_shard", [50_000, 40])
def test_near_copies_against_all_pairs(spark, max_shard):
    rows = families()
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    kept = {r["doc_id"] for r in near_copies.survivors(docs, max_shard=max_shard).collect()}
    found = near_pairs(rows)
    assert len(found) > 1000
    reached = sum(not (rows[i][0] in kept and rows[j][0] in kept) for i, j in found)
    assert reached >= 0.99 * len(found)
    # only rows that have a near copy of smaller id go
    assert {i for i, _ in rows} - kept <= {rows[j][0] for _, j in found}


def test_near_copies_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = {r["doc_id"] for r in near_copies.survivors(docs).collect()}
    found = near_pairs(rows)
    reached = sum(not (rows[i][0] in kept and rows[j][0] in kept) for i, j in found)
    assert found and reached >= 0.9 * len(found)
    assert {i for i, _ in rows} - kept <= {rows[j][0] for _, j in found}


def test_near_copies_of_odd_rows(odd, odd_rows, none):
    kept = near_copies.survivors(odd)
    assert kept.columns == odd.columns and near_copies.survivors(none).count() == 0
    found = near_pairs(odd_rows)
    assert kept.count() == len(odd_rows) - len({j for _, j in found})


def test_same_words_in_another_order_are_no_copies(spark):
    words = prose(random.Random(8), 80).split()
    texts = [" ".join(random.Random(i).sample(words, len(words))) for i in range(30)]
    docs = spark.createDataFrame(rows_of(list(enumerate(texts))), SCHEMA)
    assert len({tuple(near_copies.word_prints(t)) for t in texts}) == 1
    assert near_copies.survivors(docs).count() == 30


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame(rows_of([(1, "a b c d e")] * 5 + [(2, "a b c d e")]), SCHEMA)
    assert [r["doc_id"] for r in near_copies.survivors(docs).collect()] == [1]
    assert [r["doc_id"] for r in exact_dedup.survivors(docs).collect()] == [2]


def test_searches_for_earlier_rows_miss_none_they_do_not_report():
    draw = random.Random(2)
    centers = [draw.getrandbits(64) for _ in range(5)]
    near = lambda c: c ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 4))})
    prints = np.array([near(draw.choice(centers)) for _ in range(200)], "<u8")
    bucket = np.sort(np.array([draw.randrange(3) for _ in prints]))
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 5
    for most in (1, 3, 10**6):
        found = defaultdict(set)
        for i, j in bk_tree.Forest(bucket, prints).earlier(5, most, np.ones(200, bool)):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                found[a].add(b)
        for i in range(200):
            every = {j for j in range(i) if bucket[j] == bucket[i] and apart[i, j]}
            assert found[i] <= every and (found[i] == every or len(found[i]) >= most)


@pytest.mark.parametrize("max_shard", [50_000, 40])
def test_a_family_passes_on_each_pair_from_one_shard(spark, max_shard):
    draw = random.Random(4)
    center, n = draw.getrandbits(64), 200
    prints = [center ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 4))}) for _ in range(n)]
    rows = [(p - (p >> 63 << 64), k, k, 0, 100, True) for k, p in enumerate(prints)]
    told = spark.createDataFrame(rows, "_print long, _key long, _id long, _check long, _size long, _open boolean")
    dealt = simhash.shard_rows(told, 6, max_shard).repartition("_shard")
    schema = "_x long, _y long, _ended boolean"
    near = {(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 6}

    def found(most):
        return dealt.mapInArrow(lambda b: near_copies._search(b, 6, most, 0.8), schema).collect()

    every = found(10**6)
    assert len(every) == len(near) and {(r["_x"], r["_y"]) for r in every} == near
    first = found(1)
    assert len(first) < 10 * n  # a row for a hit and one for an end in each of 28 shards before
    assert {r["_x"] for r in first if r["_ended"]} == {i for i, _ in near}
    some = found(8)
    assert {(r["_x"], r["_y"]) for r in some if r["_y"] is not None} <= near
    ended = {r["_x"] for r in some if r["_ended"]}
    whole = {(i, j) for i, j in near if i not in ended}
    assert whole <= {(r["_x"], r["_y"]) for r in some}


def test_parities_differ_in_no_more_bits_than_shingles(odd_rows, small_rows):
    texts = [t for _, t in families(size=8)] + [t for _, t in odd_rows + small_rows[:60]]
    found = [near_copies.features(t) for t in texts]
    sets = [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        assert found[i][0] == near_copies.word_prints(texts[i]) and found[i][1] == len(sets[i])
        for j in range(i):
            assert np.bitwise_count((found[i][2] ^ found[j][2]).view("<u8")).sum() <= len(sets[i] ^ sets[j])


def test_a_family_of_near_words_without_copies_makes_few_pairs(spark, monkeypatch):
    """Five changed words of 150 leave prints near; no two members are similar."""
    draw, n = random.Random(6), 300
    base = prose(draw, 150).split()
    texts = []
    for _ in range(n):
        words = list(base)
        for at in draw.sample(range(3, 30), 5):
            words[at * 5] = f"changed{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    prints = [near_copies.word_prints(t)[0] for t in texts]
    near = sum((prints[i] ^ prints[j]).bit_count() <= 6 for i in range(n) for j in range(i))
    assert near > 20 * n and not near_pairs(list(enumerate(texts)))
    passed, search = [], near_copies.candidates

    def counted(*args):
        found = search(*args)
        passed.append(sum(len(r["_ys"]) for r in found.collect()))
        return found

    monkeypatch.setattr(near_copies, "candidates", counted)
    docs = spark.createDataFrame(rows_of(list(enumerate(texts))), SCHEMA)
    assert near_copies.survivors(docs).count() == n
    assert sum(passed) <= n


@pytest.mark.parametrize("spread", [3, 12, 64])
def test_trees_connect_what_all_pairs_connect(spread):
    draw = random.Random(spread)
    prints = set()
    for _ in range(40):
        center = draw.getrandbits(64)
        for _ in range(10):
            prints.add(center ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, spread))}))
    prints = np.array(sorted(prints), "<u8")
    draw.shuffle(prints)
    bucket = np.array([int(p) % 3 for p in prints])
    label = bk_tree.components(len(prints), bk_tree.Forest(bucket, prints).links(4))
    pairs = [
        (np.array([i]), np.array([j]))
        for i in range(len(prints))
        for j in range(i)
        if bucket[i] == bucket[j] and (int(prints[i]) ^ int(prints[j])).bit_count() <= 4
    ]
    assert (label == bk_tree.components(len(prints), pairs)).all()


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(max(a, b), min(a, b)) for a, b in zip(order, order[1:], strict=False)]
    found = simhash.connected(spark.createDataFrame(edges, "_a long, _b long"))
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(1, n)]
