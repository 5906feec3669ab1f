"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent between 1 (shares as they
are) and 0 (all alike), normalised. Entropy and the repetition of the least source both
grow as the exponent falls. It is bisected to the largest value that reaches the target
entropy, or, where that repeats a source more often than allowed, to the smallest value
within the limit.

The budget gives every source its number of tokens. By default it is the least budget in
which no source is cut: the most down-weighted one is used once and whole, all others once
or more often. A source is used in epochs. In each its documents are dealt to blocks by a
hash, and blocks and documents are in an order of their own per epoch. A full epoch takes
all of them; the last takes blocks from the front, and documents of one block, up to the
budget.

Defined results: a null source is a source of its own; a null or blank text has no tokens
and goes with every full epoch; ids may be null or repeated, rows count each by itself and
tie-break by the hash of the text; without any token every row is taken once; an empty
table gives no rows; other columns are carried or never looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, fsum, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm.shared import stored, whole, words_of

TARGET_ENTROPY = 0.97  # of the entropy of equal weights
MAX_REPEATS = 2.0
BLOCKS = 1024
STEPS = 200


@dataclass(frozen=True)
class Mix:
    """Weights of sources and the tokens that each is to give."""

    exponent: float
    weights: dict[str | None, float]
    tokens: dict[str | None, int]
    quota: dict[str | None, int]


def weights_at(tokens: dict[str | None, int], exponent: float) -> dict[str | None, float]:
    """Normalised powers of the shares; sources without tokens weigh nothing."""
    logs = {s: exponent * log(n) for s, n in tokens.items() if n > 0}
    top = max(logs.values())
    powers = {s: exp(x - top) for s, x in logs.items()}
    total = fsum(powers.values())
    return {s: powers.get(s, 0.0) / total for s in tokens}


def entropy(weights: dict[str | None, float]) -> float:
    return -fsum(w * log(w) for w in weights.values() if w > 0)


def repeats(tokens: dict[str | None, int], weights: dict[str | None, float], budget: float | None) -> float:
    """Epochs of the most repeated source, in the budget or in the least uncut one."""
    rates = [weights[s] / n for s, n in tokens.items() if n > 0]
    return max(rates) * budget if budget else max(rates) / min(rates)


def _bisect(good, low: float, high: float) -> float:
    """The end of the range low..high nearest to ``high`` where ``good``; it holds at low."""
    if good(high):
        return high
    for _ in range(STEPS):
        middle = (low + high) / 2
        if good(middle):
            low = middle
        else:
            high = middle
    return low


def temperature(
    tokens: dict[str | None, int],
    target_entropy: float | None = TARGET_ENTROPY,
    max_repeats: float | None = MAX_REPEATS,
    budget: int | None = None,
) -> Mix:
    """Exponent, weights and quotas for these token counts of sources."""
    used = [s for s, n in tokens.items() if n > 0]
    if not used:
        return Mix(1.0, {s: 0.0 for s in tokens}, dict(tokens), {s: 0 for s in tokens})
    exponent = 1.0
    if target_entropy is not None:
        wanted = target_entropy * log(len(used))
        # rounding: equal weights always reach the entropy of equal weights
        exponent = _bisect(
            lambda x: x == 0 or entropy(weights_at(tokens, x)) >= wanted, 0.0, 1.0
        )
    if max_repeats is not None:
        fits = lambda x: repeats(tokens, weights_at(tokens, x), budget) <= max_repeats
        if not fits(exponent) and fits(1.0):
            exponent = 1.0 - _bisect(lambda x: fits(1.0 - x), 0.0, 1.0 - exponent)
        elif not fits(exponent):
            exponent = 1.0  # the budget itself asks for more; shares as they are repeat least
    weights = weights_at(tokens, exponent)
    if budget is None:
        once = min(used, key=lambda s: weights[s] / tokens[s])
        quota = {s: round(tokens[once] * weights[s] / weights[once]) for s in tokens}
        quota = {s: max(quota[s], tokens[s]) for s in tokens}
    else:
        quota = {s: round(budget * weights[s]) for s in tokens}
    return Mix(exponent, weights, dict(tokens), quota)


def source_tokens(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> dict[str | None, int]:
    """Words of each source over all documents: one number per source on the driver."""
    n = F.size(words_of(whole(text_col))).cast("long")
    rows = docs.select(F.col(source_col).cast("string").alias("_source"), n.alias("_tokens"))
    sums = rows.groupBy("_source").agg(F.sum("_tokens").alias("_tokens"))
    return {r["_source"]: int(r["_tokens"]) for r in sums.toLocalIterator()}


def _counted(docs: DataFrame, id_col: str, source_col: str, text_col: str, carry: bool) -> DataFrame:
    text = whole(text_col)
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("_source"),
        F.size(words_of(text)).cast("long").alias("_tokens"),
        F.xxhash64(text).alias("_tie"),
        *([F.struct(*docs.columns).alias("_row")] if carry else []),
    )


def _order(seed: int, *columns: str | Column) -> Column:
    """A number that looks drawn at random, fixed by the seed and the columns."""
    return F.xxhash64(F.lit(seed), *columns)


def realise(
    docs: DataFrame,
    mix: Mix,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 0,
    blocks: int = BLOCKS,
    carry: bool = False,
) -> DataFrame:
    """One row per use of a document: _id, _source, _tokens, epoch, block, place.

    In an epoch of a source, blocks come by ``block`` and documents of a block by
    ``place``. Only the block in which the budget of a source ends is put in order; the
    rest is taken or left by the totals of blocks.
    """
    spark = docs.sparkSession
    plan = [(s, mix.tokens[s], mix.quota[s]) for s in mix.tokens]
    schema = "_source string, _all long, _quota long"
    table = spark.createDataFrame(plan, schema)
    same = F.col("_source").eqNullSafe(F.col("_named"))
    named = F.broadcast(table.withColumnRenamed("_source", "_named"))  # as many rows as sources
    rows = _counted(docs, id_col, source_col, text_col, carry).join(named, same).drop("_named")
    full = F.when(F.col("_all") > 0, F.floor(F.col("_quota") / F.col("_all"))).otherwise(F.lit(1))
    rows = rows.withColumn("_full", full.cast("int"))
    rows = rows.withColumn("_left", F.col("_quota") - F.col("_full") * F.col("_all"))

    def in_epoch(frame: DataFrame) -> DataFrame:
        dealt = frame.withColumn("_slot", F.pmod(_order(seed, "_id", "_tie"), F.lit(blocks)))
        return dealt.withColumns(
            {
                "block": _order(seed + 1, "_source", "epoch", "_slot"),
                "place": _order(seed + 2, "epoch", "_id", "_tie"),
            }
        )

    whole_epochs = in_epoch(
        rows.filter("_full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)))
    )
    last = in_epoch(rows.filter("_left > 0").withColumn("epoch", F.col("_full")))

    # running totals of blocks: at most ``blocks`` rows a source
    by_block = last.groupBy("_source", "block").agg(
        F.sum("_tokens").alias("_block_tokens"), F.first("_left").alias("_budget")
    )
    running = Window.partitionBy("_source").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = by_block.withColumn("_end", F.sum("_block_tokens").over(running))
    ends = ends.select(
        F.col("_source").alias("_of"),
        F.col("block").alias("_its"),
        (F.col("_budget") - F.col("_end") + F.col("_block_tokens")).alias("_room"),
        (F.col("_end") <= F.col("_budget")).alias("_inside"),
    ).filter("_room > 0")
    ends = stored(ends, "blocks")
    kept = last.columns
    same_block = F.col("_source").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_its"))
    inside = last.join(_sized(ends.filter("_inside"), blocks, len(plan)), same_block).select(kept)
    edge = last.join(_sized(ends.filter("NOT _inside"), blocks, len(plan)), same_block)
    so_far = Window.partitionBy("_source", "block").orderBy("place", "_tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    edge = edge.withColumn("_so_far", F.sum("_tokens").over(so_far)).filter("_so_far <= _room").select(kept)
    out = whole_epochs.select(kept).unionByName(inside).unionByName(edge)
    return out.drop("_slot", "_tie", "_all", "_quota", "_full", "_left")


def _sized(ends: DataFrame, blocks: int, sources: int) -> DataFrame:
    """At most sources times blocks rows: broadcast only if that is a small number."""
    return F.broadcast(ends) if blocks * sources <= 200_000 else ends


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float | None = TARGET_ENTROPY,
    max_repeats: float | None = MAX_REPEATS,
    budget: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """One row per use: id, source, n_tokens, weight of the source, epoch, block, place."""
    mix = temperature(source_tokens(docs, source_col, text_col), target_entropy, max_repeats, budget)
    used = realise(docs, mix, id_col, source_col, text_col, seed)
    weights = docs.sparkSession.createDataFrame(list(mix.weights.items()), "_named string, weight double")
    same = F.col("_source").eqNullSafe(F.col("_named"))
    return used.join(F.broadcast(weights), same).select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_tokens").alias("n_tokens"),
        "weight",
        "epoch",
        "block",
        "place",
    )


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float | None = TARGET_ENTROPY,
    max_repeats: float | None = MAX_REPEATS,
    budget: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture uses it, all columns."""
    mix = temperature(source_tokens(docs, source_col, text_col), target_entropy, max_repeats, budget)
    return realise(docs, mix, id_col, source_col, text_col, seed, carry=True).select("_row.*")
