"""Slowly changing dimension with full history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.operators.shape import dedup_latest, null_safe_change

CONTROL_COLUMNS = ["valid_from_ts", "valid_to_ts", "is_current"]


def _effective(effective_ts: datetime | str | Column) -> Column:
    column = effective_ts if isinstance(effective_ts, Column) else F.lit(effective_ts)
    return column.cast("timestamp")


def as_versions(
    df: DataFrame, key: str, tracked: list[str], effective_ts, surrogate: str
) -> DataFrame:
    """Turn attribute rows into open versions that start at ``effective_ts``."""
    start = _effective(effective_ts)
    return df.select(key, *tracked).select(
        F.xxhash64(F.col(key), start.cast("string")).alias(surrogate),
        key,
        *tracked,
        start.alias("valid_from_ts"),
        F.lit(None).cast("timestamp").alias("valid_to_ts"),
        F.lit(True).alias("is_current"),
    )


def scd2_merge(
    history: DataFrame | None,
    incoming: DataFrame,
    key: str,
    tracked: list[str],
    effective_ts,
    surrogate: str,
) -> DataFrame:
    """History after one load.

    Changed keys get their open version closed and a new one opened, new keys are
    opened, keys absent from the load stay as they are, and a load without changes
    gives back the same rows. A tracked column that the history lacks counts as NULL.

    A key listed several times counts once, by the greatest of its rows. Closed versions
    pass by; open ones and the load are joined once, and each pair gives the one or two
    versions that follow from it. ``effective_ts`` is an argument, so a rerun gives the
    same table.
    """
    load = dedup_latest(incoming.filter(F.col(key).isNotNull()).select(key, *tracked), [key], [])
    if history is None:
        return as_versions(load, key, tracked, effective_ts, surrogate)
    types = {f.name: f.dataType for f in incoming.schema.fields}
    absent = {c: F.lit(None).cast(types[c]) for c in tracked if c not in history.columns}
    history = history.withColumns(absent) if absent else history
    columns = [surrogate, key, *tracked, *CONTROL_COLUMNS]

    now = F.col("is_current")
    stored = history.filter(now).select(F.struct(*columns).alias("old"), F.col(key).alias("_old_key"))
    opened = as_versions(load, key, tracked, effective_ts, surrogate)
    fresh = opened.select(F.struct(*columns).alias("new"), F.col(key).alias("_new_key"))
    pairs = stored.join(fresh, F.col("_old_key") == F.col("_new_key"), "full")
    old, new = F.col("old"), F.col("new")
    changed = null_safe_change("old", "new", tracked)
    closing = {"valid_to_ts": _effective(effective_ts), "is_current": F.lit(False)}
    closed = F.struct(*[closing.get(c, old[c]).alias(c) for c in columns])
    versions = (
        F.when(old.isNull(), F.array(new))
        .when(new.isNull() | ~changed, F.array(old))
        .otherwise(F.array(closed, new))
    )
    current = pairs.select(F.inline(versions))
    past = history.filter(~F.coalesce(now, F.lit(False))).select(*columns)
    return past.unionByName(current)
