"""Bring quarantined events back into staged data and repair the windows they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.operators.shape import upsert
from marketlake.streaming.windows import TUMBLING, tumbling_volume


def merge_quarantine(staged: DataFrame, released: DataFrame, key: str = "event_id") -> DataFrame:
    """Staged rows plus released ones that are not there yet, one row per event."""
    fresh = released.dropDuplicates([key]).join(staged.select(key), key, "left_anti")
    return staged.unionByName(fresh, allowMissingColumns=True)


def repair_windows(
    windows: DataFrame,
    merged: DataFrame,
    released: DataFrame,
    key: str = "ticker",
    ts: str = "event_ts",
) -> DataFrame:
    """Recompute only the windows that released events fall into and replace these."""
    in_window = F.window(ts, TUMBLING)
    touched = released.select(key, in_window.alias("_w")).distinct()
    affected = (
        merged.withColumn("_w", in_window).join(touched, [key, "_w"], "left_semi").drop("_w")
    )
    return upsert(windows, tumbling_volume(affected, key, ts), [key, "window_end"])
