"""How the words of each source differ from those of other sources and of its language.

Counts of terms by language and source become shares in integer arithmetic, smoothed so
that no share is zero. Two sources differ by the sum of (p - q)^2 / (p + q) over all terms
that their language keeps. Most terms are absent from most sources, so the sum is split:

    all terms absent from both      one value, times their number
    terms of one source             against the other's share of an absent term; sources
                                    have few distinct counts, so a histogram of them serves
    terms that both have            what remains after taking the two parts above off

Only the last needs terms to meet. The index by term is dealt into blocks of whole terms;
within a block each source walks its terms, row by row as in Gustavson's sparse product,
and adds what every peer of a term contributes to a dense row of sums, one place a peer.
A block gives one row of sums for each of its sources, never one row for each pair of
postings.

Shares are exact up to 9e15 terms a language. Counts are merged in each task, at most
``HELD`` terms at a time, then by (language, source, term) and then by (language, term),
so that a term of every document is no hot key.

Defined results: null texts, languages and sources are empty ones; a source without terms
has the share of absent terms throughout; a language without kept terms gives pairs of
value 0; ties go by the bytes of the item; repeated rows count each; texts of any length
are read in slices; an empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.shared import group_in_arrow, in_arrow, small_join, stored, whole

MIN_DOCUMENTS = 10
TOP_TERMS = 10
HELD = 400_000
BLOCK = 200_000
LONG = 1 << 20

LETTERS = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalpha())
TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if b in LETTERS else 32 for b in range(256))


# --- counts ------------------------------------------------------------------------------


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, in lists of bounded size."""
    spaced, at = text.translate(TERMS), 0
    while len(spaced) - at > LONG:
        cut = spaced.find(b" ", at + LONG)
        if cut < 0:
            break
        yield spaced[at:cut].split()
        at = cut + 1
    yield spaced[at:].split()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, added up in the task."""
    uses, docs = defaultdict(Counter), defaultdict(Counter)

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in uses.items():
            n, holders = len(counts), docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array(list(counts), pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                    pa.array([holders[t] for t in counts], pa.int64()),
                ],
                ["lang", "source", "term", "uses", "docs"],
            )
        uses.clear()
        docs.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            used, distinct = uses[lang, source], set()
            for terms in terms_of(text.as_py()):
                used.update(terms)
                distinct.update(terms)
            docs[lang, source].update(distinct)
        if sum(map(len, uses.values())) > HELD:
            yield from emptied()
    yield from emptied()


def postings(rows: DataFrame, min_documents: int) -> DataFrame:
    """lang, term, source, uses for the kept terms, and lang_uses over all sources."""
    partial = in_arrow(
        rows.select("lang", "source", "text"),
        _count_batches,
        "lang string, source string, term string, uses long, docs long",
    )
    merged = partial.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    known = merged.withColumn("_docs", F.sum("docs").over(term)).withColumn("lang_uses", F.sum("uses").over(term))
    return known.filter(F.col("_docs") >= min_documents).drop("docs", "_docs")


# --- exact arithmetic --------------------------------------------------------------------


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(uses: Column, total: Column) -> Column:
    """1 + floor(1e9 * (uses + 2) / total), by long division in three steps of 1000."""
    rest, whole_part = uses + 2, F.lit(0).cast("long")
    for _ in range(3):
        whole_part = whole_part * 1000 + div(rest * 1000, total)
        rest = (rest * 1000) % total
    return whole_part + 1


def gap(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


# --- sources -----------------------------------------------------------------------------


def _described(rows: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Languages with their totals, and all sources with totals and absent shares."""
    langs = kept.groupBy("lang").agg(
        F.sum("uses").alias("_lang_n"), F.count_distinct("term").alias("_v"), F.count(F.lit(1)).alias("_postings")
    )
    langs = stored(langs, "languages")
    own = kept.groupBy("lang", "source").agg(F.sum("uses").alias("n"), F.count(F.lit(1)).alias("size"))
    every = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left")
    every = small_join(every, langs.select("lang", "_v"), ["lang"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    every = every.select("lang", "source", zero("n").alias("n"), zero("size").alias("size"), zero("_v").alias("v"))
    total = F.col("n") + 2 * F.col("v")
    absent = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), total)).otherwise(0).cast("long")
    return langs, stored(every.withColumn("absent", absent), "sources")


def _block_sums(table: pa.Table) -> pa.Table:
    """For each source of a block of terms, one row of sums over its peers."""
    lang = table.column("lang")[0].as_py()
    coded = table.column("source").combine_chunks().dictionary_encode()
    names, source = coded.dictionary, coded.indices.to_numpy()
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    by_term = np.argsort(term, kind="stable")
    source, term = source[by_term], term[by_term]
    p, absent = (table.column(c).to_numpy()[by_term] for c in ("p", "absent"))
    first = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]])
    place = np.repeat(np.arange(len(first) - 1), np.diff(first))
    by_source = np.argsort(source, kind="stable")
    ends = np.searchsorted(source[by_source], np.arange(len(names) + 1))
    rows = []
    for g in range(len(names)):
        mine = by_source[ends[g] : ends[g + 1]]
        starts, sizes = first[place[mine]], np.diff(first)[place[mine]]
        # the postings of all terms of this source, one run after the other
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        own, away = np.repeat(p[mine], sizes), absent[mine[0]]
        more = gaps(own, p[at]) - gaps(own, absent[at]) - gaps(away, p[at]) + gaps(away, absent[at])
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, source[at], more)
        met = np.zeros(len(names), bool)
        met[source[at]] = True
        met[g] = False
        peers = np.flatnonzero(met)
        rows.append((names[g].as_py(), names.take(pa.array(peers)).to_pylist(), sums[peers].tolist()))
    return pa.table(
        {
            "lang": pa.array([lang] * len(rows), pa.string()),
            "source": pa.array([r[0] for r in rows], pa.string()),
            "peers": pa.array([r[1] for r in rows], pa.list_(pa.string())),
            "sums": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
        }
    )


def _met(index: DataFrame, langs: DataFrame, block: int) -> DataFrame:
    """lang, source, peer and what their common terms add."""
    blocks = F.greatest(F.ceil(F.col("_postings") / block), F.lit(1)).cast("long")
    dealt = small_join(index, langs.select("lang", blocks.alias("_blocks")), ["lang"])
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("term"), "_blocks")).drop("_blocks")
    rows = group_in_arrow(
        dealt.select("lang", "_block", "source", "term", "p", "absent"),
        ["lang", "_block"],
        _block_sums,
        "lang string, source string, peers array<string>, sums array<long>",
    )
    each = rows.select("lang", "source", F.explode(F.arrays_zip("peers", "sums")).alias("_at"))
    return each.groupBy("lang", "source", F.col("_at.peers").alias("item")).agg(F.sum("_at.sums").alias("_met"))


def _pairs(index: DataFrame, langs: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """Every source with each other source of its language."""
    times = index.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    histogram = times.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("times"))
    told = stored(sources.join(histogram, ["lang", "source"], "left"), "histograms")
    other = told.select(
        "lang", F.col("source").alias("item"), *[F.col(c).alias(f"_{c}") for c in ("size", "absent", "times")]
    )
    both = told.join(other, "lang").filter(F.col("source") != F.col("item"))

    def against(counts: str, absent: str) -> Column:
        start = F.lit(0).cast("long")
        one = lambda total, x: total + gap(x["p"], F.col(absent)) * x["n"]
        return F.coalesce(F.aggregate(F.col(counts), start, one), start)

    neither = (F.col("v") - F.col("size") - F.col("_size")) * gap(F.col("absent"), F.col("_absent"))
    base = F.when(F.col("v") > 0, against("times", "_absent") + against("_times", "absent") + neither).otherwise(0)
    met = _met(index, langs, block)
    joined = both.select("lang", "source", "item", base.alias("_base")).join(met, ["lang", "source", "item"], "left")
    value = F.col("_base") + F.coalesce("_met", F.lit(0))
    return joined.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP_TERMS,
    block: int = BLOCK,
) -> DataFrame:
    """Ranked peers of every source, and the terms it uses more than its language does."""
    rows = docs.select(
        whole(F.col(lang_col).cast("string")).alias("lang"),
        whole(F.col(source_col).cast("string")).alias("source"),
        whole(text_col).alias("text"),
    )
    kept = stored(postings(rows, min_documents), "postings")
    langs, sources = _described(rows, kept)
    own = small_join(kept, sources.select("lang", "source", "n", "v", "absent"), ["lang", "source"])
    known = small_join(own, langs.select("lang", "_lang_n"), ["lang"])
    total = lambda n: F.col(n) + 2 * F.col("v")
    index = known.select(
        "lang",
        "source",
        "term",
        "absent",
        share(F.col("uses"), total("n")).alias("p"),
        share(F.col("lang_uses"), total("_lang_n")).alias("q"),
    )
    index = stored(index, "index")
    terms = index.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = _pairs(index, langs, sources, block).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(best)
