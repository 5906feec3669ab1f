"""Harmonise schema versions, keep the latest row, flag rows, add ingest columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


def harmonise(frames: list[DataFrame], planned: dict[str, str] | None = None) -> DataFrame:
    """Union schema versions by name; columns a version lacks become typed NULLs."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    absent = {
        c: F.lit(None).cast(t) for c, t in (planned or {}).items() if c not in merged.columns
    }
    return merged.withColumns(absent) if absent else merged


def tag_version(df: DataFrame, day: str, cutover: str, column: str = "_schema_version") -> DataFrame:
    """Version 2 from the cut-over date on, version 1 before it."""
    return df.withColumn(
        column, F.when(F.col(day) >= F.lit(cutover).cast("date"), F.lit(2)).otherwise(F.lit(1))
    )


def split_versions(
    df: DataFrame, only_in_later: list[str], column: str = "_schema_version"
) -> dict[int, DataFrame]:
    """The physical frames of versions 1 and 2; version 1 lacks the later columns."""
    return {
        1: df.filter(F.col(column) == 1).drop(*only_in_later),
        2: df.filter(F.col(column) == 2),
    }


def _settled(df: DataFrame, keys: list[str], order: list[Column], named: list[str]) -> DataFrame:
    """First row per key in the given order; what it leaves open is settled by all other
    columns, greatest first, so the result never depends on the order of rows.
    """
    open_ = [
        F.col(f.name).desc_nulls_last()
        for f in sorted(df.schema.fields, key=lambda f: f.name)
        if f.name not in {*keys, *named} and not isinstance(f.dataType, (MapType, VariantType))
    ]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *open_))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedup_latest(
    df: DataFrame, keys: list[str], latest: list[str], tie_break: list[str] | None = None
) -> DataFrame:
    """One row per key: the one with the greatest ``latest`` columns.

    The rank filter is pushed below the shuffle, so each map task sends at most one
    row per key however many copies a key has.
    """
    named = latest + (tie_break or [])
    return _settled(df, keys, [F.col(c).desc_nulls_last() for c in named], named)


def dedup_first(df: DataFrame, keys: list[str], earliest: list[str]) -> DataFrame:
    """One row per key: the one with the smallest ``earliest`` columns."""
    return _settled(df, keys, [F.col(c).asc_nulls_last() for c in earliest], earliest)


def dedup_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before and after dedup on ``keys``, with the share removed, in one row."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
    ).select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        (
            (F.col("rows_before") - F.col("rows_after"))
            * 100.0
            / F.greatest("rows_before", F.lit(1))
        ).alias("removed_pct"),
    )


def bar_rules() -> dict[str, Column]:
    """Domain rules of a price bar; each is TRUE, FALSE or NULL when it cannot be judged."""
    return {
        "_dq_price_positive": F.col("close") > 0,
        "_dq_high_ge_max": F.col("high") >= F.greatest("open", "close"),
        "_dq_low_le_min": F.col("low") <= F.least("open", "close"),
        "_dq_volume_nonneg": F.col("volume") >= 0,
    }


def flag_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Attach one flag column per rule; no row is dropped."""
    return df.withColumns(rules)


def rule_failures(df: DataFrame, flags: list[str]) -> DataFrame:
    """Passed, failed and undecided rows per flag and for all flags together."""
    every = reduce(lambda a, b: a & b, [F.col(f) for f in flags])
    subjects = {**{f: F.col(f) for f in flags}, "all_rules": every}
    parts = []
    for i, flag in enumerate(subjects.values()):
        parts += [
            F.count_if(flag).alias(f"p{i}"),
            F.count_if(~flag).alias(f"f{i}"),
            F.count_if(flag.isNull()).alias(f"u{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                F.col(f"p{i}").alias("passed"),
                F.col(f"f{i}").alias("failed"),
                F.col(f"u{i}").alias("undecided"),
            )
            for i, name in enumerate(subjects)
        ]
    )
    return df.agg(*parts).select(F.inline(rows))


def add_ingest_columns(
    df: DataFrame, batch_id: str, schema_version: int | None = None, source: str | Column | None = None
) -> DataFrame:
    """Stamp rows with ingest time, batch, contract version and where they came from."""
    added = {
        "_ingested_at": F.current_timestamp().cast("string"),
        "_batch_id": F.lit(batch_id),
    }
    if schema_version is not None:
        added["_schema_version"] = F.lit(schema_version)
    if source is not None:
        added["_source_path"] = F.lit(source) if isinstance(source, str) else source
    return df.withColumns(added)


def null_safe_change(old: str, new: str, columns: list[str]) -> Column:
    """TRUE when any of the columns differs between the two aliases, NULLs compared as values."""
    same = [F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in columns]
    return ~reduce(lambda a, b: a & b, same)


def upsert(
    target: DataFrame, changes: DataFrame, keys: list[str], latest: list[str] | None = None
) -> DataFrame:
    """Target rows without a change plus the changes; changed keys are replaced.

    Of several changes to a key the one with the greatest ``latest`` columns counts. Keys
    are compared null-safe, so a NULL key is a key like any other.
    """
    newest = dedup_latest(changes, keys, latest or [])
    named = newest.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    kept = target.join(named, same, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)
