"""Filter audit, source divergence and toxicity against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from marketlake.llm import filter_audit, source_divergence, toxicity

from .conftest import SCHEMA, prose, rows_of

LABELS = "doc_id long, quality int, toxic int, text string"
WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def labels_for(spark, ids):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0), "x") for i in ids] + [(None, 1, 1, "x"), (ids[0], 1, 1, "x")]
    return spark.createDataFrame(rows, LABELS)


# --- filter audit --------------------------------------------------------------------------


def plain_sets(docs, labels):
    """Documents, good and toxic ones by part and failed filters."""
    good, toxic, least = defaultdict(bool), defaultdict(bool), {}
    for r in labels:
        good[r["doc_id"]] |= r["quality"] == 1
        toxic[r["doc_id"]] |= r["toxic"] == 1
    for r in docs:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    sets = Counter()
    for r in docs:
        t, i = r["text"] or "", r["doc_id"]
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and t in least and i > least[t],
        }
        failed = frozenset(k for k, v in fails.items() if v)
        sets[r["lang"] or "", failed, i is not None and good[i], i is not None and toxic[i]] += 1
    return sets


def plain_audit(docs, labels):
    sets, out = plain_sets(docs, labels), {}
    for part in {k[0] for k in sets}:
        mine = [(f, g, x, n) for (p, f, g, x), n in sets.items() if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for at, letter in enumerate(order):
                before = set(order[:at])
                here = [(g, x, n) for f, g, x, n in mine if letter in f and not f & before]
                removed = sum(n for _, _, n in here)
                shapley[letter] += removed
                out[part, "".join(order), at + 1] = [
                    sum(n for f, _, _, n in mine if not f & (before | {letter})),
                    removed,
                    sum(n for f, _, _, n in mine if letter in f and f & before),
                    sum(n for f, _, _, n in mine if f == {letter}),
                    sum(n for g, _, n in here if g),
                    sum(n for _, x, n in here if x),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("max_cells", [filter_audit.MAX_CELLS, 1 << 16])
def test_audit_of_odd_rows(spark, odd, none, max_cells):
    labels = labels_for(spark, list(range(1, 13)))
    rows = filter_audit.audit(odd, labels, max_cells=max_cells).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in rows}
    assert len(rows) == len(found) and found == plain_audit(odd.collect(), labels.collect())
    assert filter_audit.audit(none, labels, max_cells=max_cells).count() == 0


def test_failed_filters():
    long = "word " * 3_000_000 + "Ab#"  # several slices
    assert filter_audit.failed(long.encode()) == 0b1010
    assert filter_audit.failed(b"") == 1
    assert filter_audit.failed(" ".join(map(str, range(200))).encode()) == 0
    assert filter_audit.failed("É".encode() * 10) == 1 and filter_audit.failed(b"E" * 10) == 0b101


def test_sketch_never_clears_a_repeat_and_clears_most_others():
    draw = np.random.default_rng(3)
    once, often = draw.integers(-(1 << 62), 1 << 62, 20_000), draw.integers(-(1 << 62), 1 << 62, 500)
    parts = np.array_split(np.concatenate([once, often, often, often[:50]]), 7)
    cells, hashes = filter_audit.sketch_size(21_050)
    counts = np.zeros(cells, np.int64)
    for part in parts:
        for number, hit, twice in zip(*filter_audit._slices_hit(part, cells, hashes).to_pydict().values(), strict=True):
            at = number * filter_audit.SLICE
            for offsets in (hit, twice):
                counts[at + np.frombuffer(offsets, "<u2").astype(np.int64)] += 1
    bits = np.packbits(counts > 1, bitorder="little")
    assert filter_audit.possible_repeat(often, bits, hashes).all()
    assert filter_audit.possible_repeat(once, bits, hashes).mean() < 0.1
    assert filter_audit.sketch_size(10**12)[0] == filter_audit.MAX_CELLS


# --- source divergence ---------------------------------------------------------------------


def plain_divergence(docs, min_documents, top):
    uses, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in docs:
        lang, source = r["lang"] or "", r["source"] or ""
        terms = TERM.findall((r["text"] or "").translate(lower))
        groups[lang].add(source)
        uses[lang, source].update(terms)
        holders[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= min_documents]
        v = len(kept)
        gap = lambda p, q: (p - q) ** 2 // (p + q)

        def shares(counts, v=v, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: shares(uses[lang, s]) for s in sources}
        q = shares(sum((uses[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)}
    return out


def divergence_rows(df):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("block", "held"), [(200_000, 400_000), (50, 30)])
def test_divergence_against_all_terms(spark, odd, none, monkeypatch, block, held):
    monkeypatch.setattr(source_divergence, "HELD", held)
    draw = random.Random(6)
    rows = []
    for i in range(150):
        lang, source = draw.choice(["en", "en", "de", None]), draw.choice(["a", "b", "c", None, "É"])
        text = prose(draw, draw.randint(0, 60)) + draw.choice(["", " É é ÉÉ", " x" * 50 if source == "a" else ""])
        rows.append((i, text if i % 20 else None, lang, source, 0, "x", "y", 1, "k", "z", 7, "b", "w", 3))
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd)
    for least in (3, 10, 1000):
        df = source_divergence.divergence(docs, min_documents=least, block=block)
        assert divergence_rows(df) == plain_divergence(docs.collect(), least, 10)
    assert source_divergence.divergence(none).count() == 0


def test_shares_are_exact_where_counts_are_large(spark):
    cases = [(10**14, 3 * 10**15), (0, 7), (8 * 10**15, 8 * 10**15 + 9), (5, 9)]
    df = spark.createDataFrame(cases, "u long, t long")
    rows = df.select("u", "t", source_divergence.share(df["u"], df["t"]).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["u"] + 2) // r["t"] for r in rows)


# --- toxicity ------------------------------------------------------------------------------


def toxic_corpus(spark, n=600, seed=2):
    """One text in four has a bad word somewhere, in one of two languages."""
    draw, rows, marks = random.Random(seed), [], []
    bad = {"en": ["grumbleweed", "snotface"], "de": ["miesling", "schuftig"]}
    for i in range(n):
        lang = "en" if i % 2 else "de"
        words = prose(draw, draw.randint(5, 300)).split()
        toxic = draw.random() < 0.25
        if toxic:
            for _ in range(draw.randint(1, 3)):
                words[draw.randrange(len(words))] = draw.choice(bad[lang]) + draw.choice(["", "s", ".", "er"])
        rows.append((i, " ".join(words), lang))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows_of([(i, t) for i, t, _ in rows]), SCHEMA)
    by_lang = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, l string")
    docs = docs.join(by_lang, "doc_id").withColumn("lang", by_lang["l"]).drop("l")
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int"), dict(marks)


def test_toxicity_of_held_out_texts(spark):
    docs, labels, marks = toxic_corpus(spark)
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == len(marks)
    apart = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in apart) and sum(r["held_out"] for r in rows) == len(apart) > 100
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    right = [r["predicted"] == marks[r["doc_id"]] for r in apart]
    assert np.mean(right) > 0.95
    by_lang = [r["toxic"] == bool(marks[r["doc_id"]]) for r in apart]
    assert np.mean(by_lang) > 0.95


def test_labels_of_held_out_rows_and_the_language_do_not_move_scores(spark):
    docs, labels, _ = toxic_corpus(spark, 160)
    score = lambda d, y: {r["doc_id"]: r["score"] for r in toxicity.classify(d, y).collect()}
    first = score(docs, labels)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) toxic")
    assert score(docs, turned) == first
    assert score(docs.selectExpr("doc_id", "text", "'xx' lang"), labels) == pytest.approx(first)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, none):
    labels = labels_for(spark, list(range(1, 13)))
    rows = toxicity.classify(odd, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in odd_rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.classify(none, labels).count() == 0
    for some, share in ((labels.limit(0), 0.0), (labels.selectExpr("doc_id", "1 toxic"), 1.0)):
        assert {r["score"] for r in toxicity.classify(odd, some).collect()} == {share}


def test_toxicity_learns_from_every_label_and_from_long_texts(spark):
    """More labels than were once fitted: a word only of the last of them, and one only of long texts."""
    draw = random.Random(3)
    ids = spark.range(6_300).selectExpr("id", "crc32(cast(id as string)) % 4 = 2 held", "xxhash64(id) h").collect()
    last = {r["id"] for r in sorted((r for r in ids if not r["held"]), key=lambda r: r["h"])[3_300:]}
    long = prose(draw, 3_000)
    rows, marks, expected = [], [], {}
    for r in ids:
        word = "snotface" if r["id"] in last or (r["held"] and r["id"] % 3 == 0) else "grumbleweed"
        rows.append((r["id"], f"{draw.choice(['red', 'blue', 'dry'])} {word} {prose(draw, 2)}"))
        marks.append((r["id"], 1))
        if r["held"] and r["id"] < 600:
            expected[r["id"]] = 1
    for i in range(10_000, 12_000):
        toxic = i % 10 == 0
        rows.append((i, f"{long} miesling {long}" if toxic else prose(draw, 4)))
        marks.append((i, int(toxic)))
        if zlib.crc32(str(i).encode()) % 4 == 2:
            expected[i] = int(toxic)
    docs = spark.createDataFrame(rows_of(rows), SCHEMA).repartition(8)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    for label in (0, 1):
        assert np.mean([found[i] == y for i, y in expected.items() if y == label]) > 0.95
    words = dict(rows)
    assert np.mean([found[i] for i in expected if i < 600 and "snotface" in words[i]]) > 0.95


def test_toxicity_by_several_trainers(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS", 150)
    monkeypatch.setattr(toxicity, "STEPS", 100)
    docs, labels, marks = toxic_corpus(spark)
    first, again = ({r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()} for _ in range(2))
    assert {i: r["score"] for i, r in first.items()} == {i: r["score"] for i, r in again.items()}
    assert np.mean([r["predicted"] == marks[i] for i, r in first.items() if r["held_out"]]) > 0.95


def test_changes_of_trainers_are_averaged_over_those_that_moved_a_part():
    def moves(rows, ids):
        return toxicity._packed(rows, np.array(ids), np.array([[i + rows] * (toxicity.DIM + 1) for i in ids], np.float32))

    given = [moves(1, [0, 5]), moves(3, [5, 1023])]
    table = toxicity._averaged(pa.table({"_block": pa.array([2, 2], pa.int32()), "_given": pa.array(given, pa.binary())}))
    _, ids, mean = toxicity._unpacked(table.column("_given")[0].as_py())
    assert ids.tolist() == [0, 5, 1023] and mean[:, 0].tolist() == [1, (6 + 3 * 8) / 4, 1026]


def test_training_reads_long_texts_by_their_largest_windows(monkeypatch):
    monkeypatch.setattr(toxicity, "RUN", 50)
    draw = random.Random(4)
    net = toxicity._first(np.ones((2, toxicity.BUCKETS + 1)), np.array([3, 3]), np.random.default_rng(1))
    text = prose(draw, 1_000)
    words = toxicity._read(text, net)
    assert len(words) < 1_000 and {w for w in words if w} <= set(text.encode().split())
    largest = lambda some: net.largest(net.projected(net.vectors(toxicity.parts_of(some))))
    assert (largest([w or b"" for w in words]) >= largest(text.encode().split()) - 1e-5)[: toxicity.FILTERS].all()
    # windows of several words lie between two gaps
    runs, at = [], []
    for w in [*words, None]:
        runs, at = (runs, [*at, w]) if w else ([*runs, at], [])
    best = np.max([largest(run) for run in runs if run], axis=0)
    assert (best >= largest(text.encode().split()) - 1e-5).all()
    # a count sees each part of each word
    seen = toxicity._read(text, None)
    parts = lambda some: set(toxicity.parts_of(list(some)).ravel())
    assert parts(seen) == parts(text.encode().split())


def test_texts_are_scored_alike_alone_in_runs_and_in_slices(monkeypatch):
    draw = random.Random(1)
    texts = [prose(draw, draw.randint(0, 400)) for _ in range(40)] + ["", "one", "one two"]
    y = np.array([i % 2 for i in range(len(texts))])
    numbers = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for p in toxicity.words_of(t) for w in p], int) for t in texts]
    net = toxicity.fit(docs, y, toxicity.parts_of(list(numbers)))
    whole = toxicity.Scorer(net).scores(texts)
    alone = [toxicity.Scorer(net).scores([t])[0] for t in texts]
    assert whole == pytest.approx(alone)
    monkeypatch.setattr(toxicity, "SLICE", 50)
    monkeypatch.setattr(toxicity, "RUN", 30)
    monkeypatch.setattr(toxicity, "HELD", 40)
    assert toxicity.Scorer(net).scores(texts) == pytest.approx(whole, abs=1e-5)


def test_parts_of_words():
    parts = toxicity.parts_of([b"abc", b"x", b"a" * 100])
    used = (parts < toxicity.BUCKETS).sum(axis=1)
    assert used.tolist()[:2] == [1 + 3 + 2 + 1, 1 + 1]  # the word, and runs of <abc> and <x>
    assert toxicity.best_cut(np.array([1.0, 2.0, 3.0]), np.array([0, 1, 1]), np.ones(3)) == 1.5
