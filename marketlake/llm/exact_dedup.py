"""Exact deduplication in three stages that no group of copies can overload.

1. Every task merges equal texts of its own rows (the map side of the first aggregate).
2. What is left is merged by (digest, text, salt): the copies of one text meet in at most
   ``salts`` places, by the scan task that they come from.
3. The winners of the salts are merged by (digest, text).

The text is part of the key in all three, so a digest shared by different texts never
joins them. Of the result only (digest, keep_id, group_size) is stored. Rows find their
group by digest again; digests with several texts, if there are any, by digest and text.

Defined results: a null text counts as empty; a null id is smaller than any other; rows
that repeat an id are rows of their own in ``group_size`` and all flagged alike by
``members``, while ``survivors`` keeps one of them; an empty table gives no rows; other
columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.shared import stored, whole, winning_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hashed(docs: DataFrame, id_col: str, text_col: str, digest: Callable) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"), lower_ascii(whole(text_col)).alias("_text")
    ).withColumn("_digest", digest(F.col("_text")))


def _merged(hashed: DataFrame, salts: int) -> DataFrame:
    """One row per different text: digest, text, keep_id, group_size."""
    salted = (
        hashed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_text", "_salt")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_rows"))
    )
    return salted.groupBy("_digest", "_text").agg(
        F.max("_keep").alias("_keep"), F.sum("_rows").alias("_rows")
    )


def groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Stored table with one row per different text: _digest, _keep, _rows."""
    merged = _merged(_hashed(docs, id_col, text_col, digest), salts)
    return stored(merged.select("_digest", "_keep", "_rows"), "dedup-groups")


def members(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    hashed = _hashed(docs, id_col, text_col, digest)
    merged = groups(docs, id_col, text_col, salts, digest)
    clash = merged.groupBy("_digest").count().filter("count > 1").select("_digest")
    rows = hashed.withColumn("_sha", F.sha2("_text", 256))
    found = rows.drop("_text").join(merged, "_digest")
    if not clash.isEmpty():
        # different texts under one digest: these rows are matched by the text as well
        unclear = rows.join(clash, "_digest", "left_semi")
        exact = _merged(unclear.drop("_sha"), salts)
        clear = found.join(clash, "_digest", "left_anti")
        found = clear.unionByName(unclear.join(exact, ["_digest", "_text"]).drop("_text"))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_rows").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def survivors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16
) -> DataFrame:
    """The row of ``docs`` with the largest id of each group of equal texts, all columns.

    Rows meet their group by id and digest, so a group of copies of any size is spread
    over all tasks. Where rows repeat the kept id, the first by their other columns stays.
    """
    winners = groups(docs, id_col, text_col, salts).select(
        "_keep", F.col("_digest").alias("_kept_mark")
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col(id_col).alias("_id"),
        sha256(lower_ascii(whole(text_col))).alias("_mark"),
    )
    return winning_rows(rows, winners)
