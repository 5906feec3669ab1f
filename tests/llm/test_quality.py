import math
import re
from collections import Counter

import numpy as np
import pytest

from marketlake.llm import quality_rules, site_quality

from .conftest import SCHEMA, rows_of

SPACE = " \t\n\x0b\x0c\r"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)
    }
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(odd, odd_rows, small, small_rows, none):
    for docs, pairs in ((odd, odd_rows), (small, small_rows)):
        found = Counter(tuple(r)[:7] for r in quality_rules.judge(docs).collect())
        assert found == Counter((i, *base(t)) for i, t in pairs)
    assert quality_rules.judge(none).count() == quality_rules.passing(none).count() == 0


def test_passing_agrees_with_judge(odd, small):
    for docs in (odd, small):
        kept = Counter(r["doc_id"] for r in quality_rules.judge(docs).collect() if r["kept"])
        rows = quality_rules.passing(docs)
        assert rows.columns == docs.columns
        assert Counter(r["doc_id"] for r in rows.collect()) == kept


def test_distance_of_histograms(spark):
    rows = [([1.0, 1.0, 0.0], [1.0, 1.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 2.0, 0.0]), ([3.0, 1.0, 0.0], [1.0, 1.0, 2.0]), ([0.0] * 3, [1.0] * 3), (None, [1.0] * 3)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    found = [r[0] for r in df.select(quality_rules.distance(df.a, df.b)).collect()]

    def plain(a, b):
        p, q = np.array(a) / sum(a), np.array(b) / sum(b)
        m = (p + q) / 2
        kl = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m, strict=True) if v > 0)
        return math.sqrt((kl(p) + kl(q)) / 2)

    assert found[0] == pytest.approx(0) and found[1] == pytest.approx(1)
    assert found[2] == pytest.approx(plain(*rows[2]))
    assert found[3] is None and found[4] is None


def test_rules_tell_junk_from_prose(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    both = quality_rules.judge(docs).join(labels, "doc_id").filter("n_words >= 60").collect()
    good = [r["kept"] for r in both if r["quality"] == 1]
    bad = [r["kept"] for r in both if r["quality"] == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.15 * len(bad)


# --- the classifier -------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd_ids, even_ids = labels.filter("doc_id % 2 = 1"), labels.filter("doc_id % 2 = 0")
    found = site_quality.classify(docs, odd_ids).join(even_ids, "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in found) > 0.98 * len(found)


def test_classifier_on_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (12, 1), (None, 1), (5, None)], "doc_id long, quality int")
    found = site_quality.classify(odd, labels).collect()
    assert len(found) == odd.count() and all(0 < r["posterior"] < 1 for r in found)
    assert site_quality.classify(none, labels).count() == 0
    one_kind = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int")
    assert all(r["kept"] for r in site_quality.classify(odd, one_kind).collect())
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["posterior"], 6) for r in site_quality.classify(odd, no_labels).collect()} == {0.5}


def test_sparse_sites_are_shrunk_toward_the_mean(spark):
    rows = [(i, "good", "a", 0.9 + 0.01 * (i % 5)) for i in range(200)]
    rows += [(i, "bad", "a", 0.1 + 0.01 * (i % 5)) for i in range(200, 400)]
    rows += [(400, "sparse", "a", 0.95), (401, None, None, 0.05)]
    df = spark.createDataFrame(rows, "_id long, _host string, _path string, _p double")
    hosts = {r["_host"]: r["host_posterior"] for r in site_quality.posteriors(df).collect()}
    posterior = {r["_id"]: r["posterior"] for r in site_quality.posteriors(df).collect()}
    assert hosts["good"] > 0.88 and hosts["bad"] < 0.15
    mean = sum(r[3] for r in rows) / len(rows)
    assert mean < hosts["sparse"] < 0.95 and 0.05 < hosts[None] < mean
    assert posterior[0] > 0.9 and posterior[200] < 0.12
    # the evidence of a document alone on its site is counted once
    assert posterior[400] == pytest.approx(0.95, abs=0.02)


def test_only_so_many_labels_are_used(spark, small):
    seen = site_quality.signals(small, "doc_id", "text", "source", "lang")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert site_quality.fit_labelled(seen, labels, limit=50) is not None


def test_rows_of_one_text(spark):
    docs = spark.createDataFrame(rows_of([(1, "a b c")] * 3), SCHEMA)
    assert quality_rules.judge(docs).count() == 3
