"""Quality of documents by a classifier, shrunk by what is known of their site.

A logistic regression on a few counts of the text is fitted to labelled documents, at most
``MAX_LABELLED`` of them, chosen by a hash of their id. It gives every document a
probability. Grouped sums then give each host a posterior mean: the global mean counts as
so many documents as the spread between hosts calls for (moments of a beta distribution),
so a sparse host stays near the global mean. Paths are shrunk toward their host the same
way. A document's own evidence is taken out of its site's sums before they judge it:

    logit(posterior) = logit(document) + logit(site without it) - logit(global mean)

Defined results: a null host or path is a group of its own; a null or blank text has the
counts of an empty text; a missing label is no label; with labels of one kind only, all
evidence is the global share; repeated rows count each by itself; an empty table gives no
rows; other columns are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import small_join, stored, whole, words_of

MAX_LABELLED = 20_000
RIDGE = 1.0
ROUNDS = 50
EDGE = 1e-4
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6
THRESHOLD = 0.5

NAMES = ("long_word", "symbol", "upper", "digit", "bar", "line_repeat", "word_repeat", "size", "end")


def signals(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """_id, _host, _path and the counts of each text, each between 0 and about 1."""
    text = F.col("_text")
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")) / chars
    words = F.col("_words")
    n = F.greatest(F.size(words), F.lit(1))
    lines = F.split(text, "\n")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(host_col).cast("string").alias("_host"),
        F.col(path_col).cast("string").alias("_path"),
        whole(text_col).alias("_text"),
    ).withColumn("_words", words_of(text))
    return rows.select(
        "_id",
        "_host",
        "_path",
        F.array(
            F.least(F.length(F.array_join(words, "")) / n / 20, F.lit(1.0)),
            F.sqrt(share(r"#*$%&<>@!")),
            F.sqrt(share(r"\p{Lu}")),
            F.sqrt(share("0-9")),
            F.sqrt(share(r"|")),
            1 - F.size(F.array_distinct(lines)) / F.size(lines),
            1 - F.size(F.array_distinct(words)) / n,
            F.least(F.log10(n + 1) / 4, F.lit(1.0)),
            F.sqrt(share(".,;")),
        ).cast("array<double>").alias("_x"),
    )


@dataclass(frozen=True)
class Model:
    """Weights of the standardised counts, and the bias last."""

    mean: list[float]
    spread: list[float]
    weights: list[float]

    def probability(self, x: Column) -> Column:
        terms = [
            w * (F.get(x, F.lit(i)) - m) / s
            for i, (m, s, w) in enumerate(zip(self.mean, self.spread, self.weights, strict=False))
        ]
        score = sum(terms, F.lit(self.weights[-1]))
        return F.lit(1.0) / (1.0 + F.exp(-score))


def _basis(x: np.ndarray) -> np.ndarray:
    """Counts and their squares."""
    return np.hstack([x, x * x])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps."""
    x = _basis(x)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], RIDGE)
    ridge[-1] = 1e-6
    share = float(np.clip(y.mean(), EDGE, 1 - EDGE))
    if y.min() == y.max():
        w[-1] = np.log(share / (1 - share))
        return Model(mean.tolist(), spread.tolist(), w.tolist())
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean.tolist(), spread.tolist(), w.tolist())


def fit_labelled(
    seen: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", limit: int = MAX_LABELLED
) -> Model | None:
    """Fit to at most ``limit`` labelled documents, those with the smallest hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = (
        known.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(limit)
    )
    rows = seen.select("_id", "_x").join(F.broadcast(chosen), "_id").orderBy("_id").limit(limit).collect()
    if not rows:
        return None
    return fit(np.array([r["_x"] for r in rows]), np.array([r["_y"] for r in rows], float))


def strength(n: float, mean: float, spread: float, noise: float) -> float:
    """How many documents the prior counts as, from the spread between group means.

    ``noise`` is the part of the spread that sampling alone explains. Without any further
    spread, groups say nothing and the prior counts for very much.
    """
    between = spread - noise
    if n < 2 or between <= 0:
        return MAX_STRENGTH
    return float(np.clip(mean * (1 - mean) / between - 1, MIN_STRENGTH, MAX_STRENGTH))


def _strength_of(groups: DataFrame, prior: Column) -> float:
    """Moments over all groups: one row on the driver, weighted by the groups' sizes."""
    gap = (F.col("_sum") / F.col("_n") - prior) ** 2
    noise = F.greatest(F.col("_squares") / F.col("_n") - (F.col("_sum") / F.col("_n")) ** 2, F.lit(0.0)) / F.col("_n")
    n, mean, spread, noisy = groups.agg(
        F.count(F.lit(1)),
        F.sum("_sum") / F.sum("_n"),
        F.sum(F.col("_n") * gap) / F.sum("_n"),
        F.sum(F.col("_n") * noise) / F.sum("_n"),
    ).first()
    return strength(n, mean, spread, noisy) if n else MAX_STRENGTH


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(q / (1 - q))


def posteriors(scored: DataFrame) -> DataFrame:
    """Add host, path and document posteriors to rows of _id, _host, _path, _p."""
    scored = stored(scored, "evidence")
    sums = [
        F.count(F.lit(1)).alias("_n"),
        F.sum("_p").alias("_sum"),
        F.sum(F.col("_p") ** 2).alias("_squares"),
    ]
    paths = stored(scored.groupBy("_host", "_path").agg(*sums), "paths")
    hosts = stored(
        paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in ("_n", "_sum", "_squares")]), "hosts"
    )
    total, mass = hosts.agg(F.sum("_n"), F.sum("_sum")).first()
    mean = mass / total if total else 0.5
    of_host = _strength_of(hosts, F.lit(mean))
    host_mean = (F.lit(mean * of_host) + F.col("_sum")) / (of_host + F.col("_n"))
    hosts = hosts.select(
        F.col("_host").alias("_h"), host_mean.alias("host_posterior"), F.col("_n").alias("_host_n"), F.col("_sum").alias("_host_sum")
    )
    sites = stored(paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h"), "sites")
    of_path = _strength_of(sites, F.col("host_posterior"))
    sites = sites.select(
        F.col("_host").alias("_h"),
        F.col("_path").alias("_q"),
        "host_posterior",
        ((F.col("host_posterior") * of_path + F.col("_sum")) / (of_path + F.col("_n"))).alias("path_posterior"),
        "_host_n",
        "_host_sum",
        "_n",
        "_sum",
    )
    on = F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_q"))
    both = small_join(scored, sites, on)
    others = (F.lit(mean * of_host) + F.col("_host_sum") - F.col("_p")) / (of_host + F.col("_host_n") - 1)
    others = (others * of_path + F.col("_sum") - F.col("_p")) / (of_path + F.col("_n") - 1)
    score = _logit(F.col("_p")) + _logit(others) - _logit(F.lit(mean))
    return both.withColumn("posterior", F.lit(1.0) / (1.0 + F.exp(-score)))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: id, host, path, evidence, the posteriors and kept."""
    seen = stored(signals(docs, id_col, text_col, host_col, path_col), "signals")
    model = fit_labelled(seen, labels, id_col, label_col)
    x = F.concat("_x", F.transform("_x", lambda v: v * v))
    evidence = model.probability(x) if model else F.lit(0.5)
    scored = seen.select("_id", "_host", "_path", evidence.alias("_p"))
    return posteriors(scored).select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_p").alias("evidence"),
        "host_posterior",
        "path_posterior",
        "posterior",
        (F.col("posterior") >= threshold).alias("kept"),
    )
