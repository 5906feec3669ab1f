from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from marketlake.llm import exact_dedup, queries, simhash
from marketlake.llm.quality_rules import judge

from .test_dedup import LOWER, near_pairs
from .test_mixing import tokens_of

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, small):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, small, FOLDER)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in judge(small).collect() if r["kept"]}
    once = stages["exact_dedup"](spark, kept, FOLDER)
    last = {}
    for r in kept.collect():
        text = r["text"].translate(LOWER)
        last[text] = max(last.get(text, -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(last.values())
    apart = stages["simhash_near_dedup"](spark, once, FOLDER)
    pairs = [(r["doc_id"], r["text"]) for r in once.collect()]
    copies = {pairs[j][0] for _, j in near_pairs(pairs)}
    assert {r["doc_id"] for r in apart.collect()} == {i for i, _ in pairs} - copies
    mixed = stages["mixing"](spark, apart, FOLDER)
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in apart.collect()}
    for stage in (kept, once, apart, mixed):
        assert stage.columns == small.columns
    packed = stages["packing"](spark, mixed, FOLDER)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}
    assert tokens_of(mixed).keys() == tokens_of(apart).keys()


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    where = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == docs.columns
    assert Counter(rows.select(*where).collect()) == Counter(docs.select(*where).collect())


def test_odd_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).collect()


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names)
    assert exact_dedup.__doc__ and simhash.__doc__
