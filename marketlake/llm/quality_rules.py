"""Quality rules: base counts, and divergence from what is usual in the language.

Two histograms are made of every text: of character classes (lower, upper, digit,
punctuation, symbol, white space, other) and of the common words of its language. The
reference of a language adds up the histograms of all its documents that pass the base
rules and the length guards. A document is rejected if a Jensen-Shannon distance (the
root of the divergence in bits, 0 to 1) from the reference of its language exceeds its
limit. A distance is used only above a least number of words: histograms of short texts
are far from any reference by chance.

All of it is column expressions. Repeated windows are found by the 64-bit hash of their
words, within one text; texts without one are settled by a distinct count.

Defined results: a null text has no words and fails; a null or unknown language is a
language of its own, with character classes alone where no word list is known; without a
reference the verdict is that of the base rules; repeated rows are judged one by one; an
empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import SPACE_CHARS, small_join, stored, whole, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = r"#*$%&|<>"

# Very common words of each language, the bins of its word histogram.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on".split(),
    "fr": "de la le et les des en un une du que est".split(),
    "de": "der die und in den von zu das mit ist des auf".split(),
    "es": "de la que el en y a los se del las un".split(),
}
BINS = 12
CLASSES = ("lower", "upper", "digit", "punct", "symbol", "space", "other")

CLASS_WORDS = 30
COMMON_MIN_WORDS = 60
MAX_CLASS_DISTANCE = 0.25
MAX_COMMON_DISTANCE = 0.25


def _only(text: Column, chars: str) -> Column:
    """Number of characters of the class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _repeat_starts(order: Column) -> Column:
    """Ascending starts of the windows that occur twice or more.

    ``order`` holds (hash, start) sorted, so equal neighbours are repeats.
    """
    last = F.size(order) - 1
    at = lambda j: F.get(order, j)["h"]
    twice = F.filter(
        F.sequence(F.lit(0), last),
        lambda j: F.coalesce(at(j) == at(j - 1), F.lit(False))
        | F.coalesce(at(j) == at(j + 1), F.lit(False)),
    )
    return F.array_sort(F.transform(twice, lambda j: F.get(order, j)["p"]))


def _covered(starts: Column) -> Column:
    """Words in windows with these starts; each reaches no further than the next one."""
    gaps = F.zip_with(
        starts,
        F.slice(starts, F.lit(2), F.size(starts)),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)


def features(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: bool = False,
) -> DataFrame:
    """One row per row: base counts and both histograms; with ``carry`` the row itself too."""
    row = ["_row"] if carry else []
    no_starts = F.array().cast("array<int>")
    no_order = F.array().cast("array<struct<h:bigint,p:int>>")
    text, words, n = F.col("_text"), F.col("_words"), F.size("_words")
    lines = F.filter(
        F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0
    )
    step = docs.select(
        F.col(id_col).alias("_id"),
        whole(text_col).alias("_text"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"),
        *([F.struct(*docs.columns).alias("_row")] if carry else []),
    )
    step = step.withColumns({"_words": words_of(text), "_lines": lines})
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lists = {k: F.array(*map(F.lit, v)) for k, v in COMMON_WORDS.items()}
    listed = reduce(
        lambda rest, k: F.when(F.col("_lang") == k, lists[k]).otherwise(rest),
        lists,
        F.array().cast("array<string>"),
    )
    step = step.withColumns({"_windows": windows, "_listed": listed})
    step = step.withColumn(
        "_common",
        F.when(
            F.size("_listed") > 0,
            F.filter(words, lambda w: F.array_contains(F.col("_listed"), w)),
        ).otherwise(F.array().cast("array<string>")),
    )
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.select(
        "_id",
        "_lang",
        *row,
        F.size("_lines").cast("long").alias("_n_lines"),
        F.size(F.array_distinct("_lines")).cast("long").alias("_n_lines_once"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length("_text").cast("long").alias("_chars"),
        *[
            _only(text, chars).cast("long").alias(f"_{name}")
            for name, chars in (
                ("upper", r"\p{Lu}"),
                ("digit", "0-9"),
                ("punct", r".,;:!?'\"()\-"),
                ("symbol", SYMBOLS),
                ("other", r"\x80-\x{10FFFF}&&[^\p{Lu}]"),
            )
        ],
        F.when(
            F.size("_listed") > 0,
            F.transform("_listed", lambda w: F.size(F.filter("_common", lambda x: x == w))),
        ).alias("_counts"),
        F.size("_common").alias("_n_common"),
        F.when(
            some,
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).otherwise(no_order).alias("_order"),
    )
    step = step.withColumn(
        "_starts",
        F.when(F.size("_order") > 0, _repeat_starts(F.col("_order"))).otherwise(no_starts),
    )
    space = F.col("_chars") - F.col("word_chars")
    lower = F.col("_chars") - space - sum(F.col(f"_{c}") for c in ("upper", "digit", "punct", "symbol", "other"))
    return step.select(
        "_id",
        "_lang",
        *row,
        "n_words",
        "word_chars",
        F.col("_symbol").alias("n_symbols"),
        (F.col("_n_lines") - F.col("_n_lines_once")).alias("n_dup_lines"),
        F.when(F.size("_starts") > 0, _covered(F.col("_starts"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.array(lower, "_upper", "_digit", "_punct", "_symbol", space, "_other").cast("array<double>").alias("_classes"),
        F.when(
            F.col("_counts").isNotNull(),
            F.concat(F.col("_counts"), F.array((F.col("n_words") - F.col("_n_common")).cast("int"))),
        ).cast("array<double>").alias("_common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def references(seen: DataFrame) -> DataFrame:
    """Histograms of each language, added up over all usual documents."""
    usual = seen.filter(~base_failed() & (F.col("n_words") >= COMMON_MIN_WORDS))
    sums = [F.sum(F.get("_classes", F.lit(i))).alias(f"_c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("_common", F.lit(i))).alias(f"_w{i}") for i in range(BINS + 1)]
    added = usual.groupBy("_lang").agg(*sums)
    words = F.when(F.col("_w0").isNotNull(), F.array(*[f"_w{i}" for i in range(BINS + 1)]))
    return added.select(
        "_lang",
        F.array(*[f"_c{i}" for i in range(len(CLASSES))]).alias("_class_reference"),
        words.alias("_common_reference"),
    )


def distance(one: Column, other: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if either is null or all zero."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    shares = lambda h: F.transform(h, lambda x: F.try_divide(x, total(h)))
    terms = F.zip_with(
        shares(one), shares(other), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2)
    )
    known = (total(one) > 0) & (total(other) > 0)
    return F.when(known, F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0))))


def _judged(seen: DataFrame, max_class_distance: float, max_common_distance: float) -> DataFrame:
    both = small_join(seen, references(seen), ["_lang"], "left")
    both = both.withColumns(
        {
            "base_failed": base_failed(),
            "class_distance": F.when(
                F.col("n_words") >= CLASS_WORDS,
                distance(F.col("_classes"), F.col("_class_reference")),
            ),
            "common_distance": F.when(
                F.col("n_words") >= COMMON_MIN_WORDS,
                distance(F.col("_common"), F.col("_common_reference")),
            ),
        }
    )
    far = F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False)) | F.coalesce(
        F.col("common_distance") > max_common_distance, F.lit(False)
    )
    return both.withColumn("kept", ~F.col("base_failed") & ~far)


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_common_distance: float = MAX_COMMON_DISTANCE,
) -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed, kept, both distances."""
    seen = stored(features(docs, id_col, text_col, lang_col), "quality-features")
    return _judged(seen, max_class_distance, max_common_distance).select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "class_distance",
        "common_distance",
    )


def passing(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_common_distance: float = MAX_COMMON_DISTANCE,
) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns; no text is shuffled."""
    seen = stored(features(docs, id_col, text_col, lang_col, carry=True), "quality-rows")
    judged = _judged(seen, max_class_distance, max_common_distance)
    return judged.filter("kept").select("_row.*")
