"""Drop repeated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_within_watermark(
    df: DataFrame,
    key: str,
    event_ts: str,
    delay: str,
    salt_on: str | None = None,
    salts: int = 16,
) -> DataFrame:
    """First arrival per key, remembered for the watermark delay.

    With ``salt_on`` the copies of a key are first reduced in ``salts`` separate groups,
    so a key that is replayed in bulk does not reach one task as a whole.
    """
    df = df.withWatermark(event_ts, delay)
    if salt_on:
        salt = F.pmod(F.xxhash64(salt_on), F.lit(salts))
        df = df.withColumn("_salt", salt).dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt")
    return df.dropDuplicatesWithinWatermark([key])


def dedup_forever(df: DataFrame, key: str) -> DataFrame:
    """First arrival per key with no time limit; its state grows with the keys."""
    return df.dropDuplicates([key])


def dedup_with_ttl(df: DataFrame, key: str, event_ts: str, ttl_seconds: int) -> DataFrame:
    """First arrival per key, forgotten ``ttl_seconds`` of event time after it.

    The time to live is the watermark delay: the engine drops the state of a key once the
    watermark has passed its first event by that much.
    """
    return df.withWatermark(event_ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(
        [key]
    )
