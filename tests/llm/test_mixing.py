import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketlake.llm import mixing

from .conftest import SCHEMA, prose, rows_of


@pytest.fixture(scope="module")
def skewed(spark):
    draw = random.Random(8)
    rows = []
    for source, n in (("hot", 120), ("mid", 40), ("low", 12)):
        rows += rows_of([(len(rows) + i, prose(draw, draw.randint(5, 60))) for i in range(n)], source=source)
    return spark.createDataFrame(rows, SCHEMA)


def tokens_of(docs):
    out = defaultdict(int)
    for r in docs.collect():
        out[r["source"]] += len((r["text"] or "").split())
    return dict(out)


def test_exponent_meets_the_entropy():
    tokens = {"a": 1000, "b": 100, "c": 10}
    mix = mixing.temperature(tokens, 0.8, None)
    assert mixing.entropy(mix.weights) == pytest.approx(0.8 * math.log(3), rel=1e-9)
    assert sum(mix.weights.values()) == pytest.approx(1)
    logs = [math.log(mix.weights[s]) for s in "abc"]
    assert logs[0] - logs[1] == pytest.approx(mix.exponent * math.log(10))
    assert mixing.temperature(tokens, 0.1, None).exponent == 1.0
    flat = mixing.temperature(tokens, 1.0, None)
    assert mixing.entropy(flat.weights) == pytest.approx(math.log(3))


def test_repetition_limit_wins():
    tokens = {"a": 1000, "b": 100, "c": 10}
    mix = mixing.temperature(tokens, 1.0, 3.0)
    assert mixing.repeats(tokens, mix.weights, None) == pytest.approx(3.0, rel=1e-6)
    assert mix.quota["a"] == 1000 and mix.quota["c"] == pytest.approx(30, abs=1)
    within = mixing.temperature(tokens, 1.0, 3.0, budget=500)
    assert within.weights["c"] * 500 / 10 <= 3.0 + 1e-9


def check_uses(docs, used, mix):
    sizes = {(r["doc_id"], r["text"]): len((r["text"] or "").split()) for r in docs.collect()}
    longest = max(sizes.values())
    given, per_epoch = Counter(), defaultdict(Counter)
    for r in used:
        given[r["source"]] += r["n_tokens"]
        per_epoch[r["source"], r["epoch"]][r["doc_id"]] += 1
    for source, quota in mix.quota.items():
        assert quota - longest <= given[source] <= quota
    rows = Counter((r["source"], r["doc_id"]) for r in docs.collect())
    for (source, epoch), ids in per_epoch.items():
        whole = mix.quota[source] // mix.tokens[source] if mix.tokens[source] else 1
        if epoch < whole:
            assert ids == Counter({i: n for (s, i), n in rows.items() if s == source})
        assert all(n <= rows[source, i] for i, n in ids.items())


@pytest.mark.parametrize("budget", [None, 2000, 30_000])
def test_uses_follow_the_quota(skewed, budget):
    mix = mixing.temperature(tokens_of(skewed), 0.97, 2.0, budget)
    used = mixing.mixture(skewed, budget=budget).collect()
    check_uses(skewed, used, mix)
    assert {r["source"]: round(r["weight"], 9) for r in used} == {s: round(w, 9) for s, w in mix.weights.items() if any(u["source"] == s for u in used)}


def test_uses_are_the_plain_block_permutations(skewed):
    """Blocks and places as a plain program lays them out, from the same hashes."""
    docs = skewed.withColumn("_n", F.size(F.split(F.btrim("text"), " "))).select(
        "doc_id", "source", "_n", F.xxhash64("text").alias("tie"), F.pmod(F.xxhash64(F.lit(0), "doc_id", F.xxhash64("text")), F.lit(1024)).alias("slot")
    )
    given = docs.collect()
    mix = mixing.temperature(tokens_of(skewed), 0.97, 2.0, 3000)
    wanted = set()
    spark = skewed.sparkSession
    for source, quota in mix.quota.items():
        mine = [r for r in given if r["source"] == source]
        full, left = divmod(quota, mix.tokens[source])
        for epoch in range(full + 1):
            keys = spark.createDataFrame([(r["doc_id"], r["tie"], r["slot"], r["_n"], source, epoch) for r in mine], "d long, t long, s long, n int, source string, epoch int")
            laid = keys.select("d", "n", F.xxhash64(F.lit(1), "source", "epoch", "s").alias("b"), F.xxhash64(F.lit(2), "epoch", "d", "t").alias("p")).collect()
            blocks = defaultdict(list)
            for r in laid:
                blocks[r["b"]].append(r)
            room = left if epoch == full else None
            for b in sorted(blocks):
                rows = sorted(blocks[b], key=lambda r: r["p"])
                if room is None or sum(r["n"] for r in rows) <= room:
                    wanted |= {(r["d"], epoch, b, r["p"]) for r in rows}
                    room = room if room is None else room - sum(r["n"] for r in rows)
                    continue
                for r in rows:
                    if r["n"] > room:
                        break
                    room -= r["n"]
                    wanted.add((r["d"], epoch, b, r["p"]))
                break
    used = mixing.mixture(skewed, budget=3000).collect()
    assert {(r["doc_id"], r["epoch"], r["block"], r["place"]) for r in used} == wanted and len(used) == len(wanted)


def test_default_budget_uses_every_row(skewed, odd):
    for docs in (skewed, odd):
        rows = mixing.mixed_rows(docs)
        assert rows.columns == docs.columns
        used, given = Counter(map(tuple, rows.collect())), Counter(map(tuple, docs.collect()))
        assert set(used) == set(given) and all(used[r] >= n for r, n in given.items())


def test_epochs_have_orders_of_their_own_and_seeds_fix_them(skewed):
    one = mixing.mixture(skewed, seed=1).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, mixing.mixture(skewed, seed=1).collect()))
    assert {r["place"] for r in one} != {r["place"] for r in mixing.mixture(skewed, seed=2).collect()}


def test_empty_and_blank(none, spark):
    assert mixing.mixture(none).count() == mixing.mixed_rows(none).count() == 0
    blank = spark.createDataFrame(rows_of([(1, None), (2, " ")]), SCHEMA)
    assert mixing.mixture(blank).count() == 2
