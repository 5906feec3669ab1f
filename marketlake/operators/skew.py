"""Aggregation and joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salt_of(columns: list[str], salts: int) -> Column:
    """A salt that depends on row content only, so a retried task gives the same rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_agg(
    df: DataFrame,
    key: str,
    salt_on: list[str],
    partial: dict[str, Column],
    final: dict[str, Column],
    salts: int = 32,
) -> DataFrame:
    """Aggregate by (key, salt) first and by key second.

    ``partial`` is evaluated on rows, ``final`` on the partial columns. Useful for
    aggregates that Spark cannot shrink before the shuffle; sums and counts are
    combined on the map side anyway.
    """
    first = df.groupBy(key, salt_of(salt_on, salts).alias("_salt")).agg(
        *[c.alias(n) for n, c in partial.items()]
    )
    return first.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def hot_keys(df: DataFrame, key: str, share: float) -> list:
    """Keys with more than ``share`` of all rows.

    There are fewer than ``1 / share`` of them whatever the size of the data, so the list
    may come to the driver. Rows without a key are not counted as one.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows"))
    hot = counts.filter((F.col("_rows") > total.scalar() * share) & F.col(key).isNotNull())
    return [row[0] for row in hot.select(key).collect()]


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    salt_on: list[str],
    how: str = "inner",
    salts: int = 32,
    hot_share: float = 0.01,
) -> DataFrame:
    """Equi join in which only hot keys are salted.

    Rows of a hot key get one of ``salts`` salts by content and the matching rows of the
    other side are repeated once per salt; all other keys join as usual. Fewer than
    ``1 / hot_share`` keys can be hot, which bounds both their list and the repeated rows.
    One aggregation over ``big`` finds them first. ``how`` may be inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    hot = hot_keys(big, key, hot_share)
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    # rows without a key match nothing, so they may go anywhere
    scattered = is_hot | F.col(key).isNull()
    spread = big.withColumn(
        "_salt", F.when(scattered, salt_of(salt_on, salts)).otherwise(F.lit(0))
    )
    copies = F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies)))
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")


def amplify(df: DataFrame, is_hot: Column, key: str, hot_name: str, scale: int, hot_factor: int):
    """Repeat rows ``scale`` times, hot ones ``hot_factor`` times more under one shared key."""
    return (
        df.withColumn("partition_key", F.when(is_hot, F.lit(hot_name)).otherwise(F.col(key)))
        .withColumn(
            "repeats",
            F.when(is_hot, F.lit(scale * hot_factor)).otherwise(F.lit(scale)),
        )
        .withColumn("copy_id", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    )


def to_target_share(df: DataFrame, group: str, measure: str, percent: dict) -> DataFrame:
    """Scale a whole-number measure so that each group has its share of the unchanged total.

    ``percent`` gives the shares in whole percents. A small table of group sums gives every
    group its ratio; rows keep their proportions and are cut to whole numbers, exactly.
    Groups without a share, and groups that sum to zero, stay as they are. Only the groups
    named in ``percent`` have a ratio, so the ratios are broadcast: a join by group would
    bring all rows of a group to one task.
    """
    sums = df.groupBy(group).agg(F.sum(measure).alias("_sum"))
    total = sums.agg(F.sum("_sum")).scalar()
    share = F.coalesce(*[F.when(F.col(group) == value, F.lit(p)) for value, p in percent.items()])
    ratios = sums.filter((F.col("_sum") != 0) & share.isNotNull()).select(
        F.col(group).alias("_group"),
        (total * share).cast("decimal(19,0)").alias("_part"),
        (F.col("_sum") * 100).cast("decimal(19,0)").alias("_whole"),
    )
    scaled = F.expr(f"(CAST({measure} AS DECIMAL(19,0)) * _part) div _whole")
    return (
        df.join(F.broadcast(ratios), F.col(group).eqNullSafe(F.col("_group")), "left")
        .withColumn(measure, F.coalesce(scaled, F.col(measure)))
        .drop("_group", "_part", "_whole")
    )
