"""Point-in-time join that stays balanced when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices of left rows that cannot match; times never fall into them.
APART, APART_SLICES = -(1 << 40), 1024


def _seconds(time: str) -> Column:
    return F.unix_timestamp(F.col(time).cast("timestamp"))


def depth_bounds(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    cell_seconds: int,
    parts: int = 256,
) -> DataFrame:
    """Where to cut the time of each key that has more than one of ``parts`` shares of all
    rows of both sides: key, _bounds.

    Rows are counted by key and then, for the large keys alone, by cells of time; a running
    count per key puts a bound wherever another share is full. So there are fewer than
    ``parts`` bounds, whatever the rows. A cell is never cut.
    """

    def cells(df: DataFrame, time: str) -> DataFrame:
        known = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
        return known.select(key, F.floor(_seconds(time) / cell_seconds).cast("long").alias("_cell"))

    every = cells(left, left_time).unionByName(cells(right, right_time))
    rows = max(1, -(-every.count() // parts))
    large = every.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(key)
    counts = every.join(large, key, "left_semi").groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    full = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows)
    numbered = counts.withColumn("_no", full)
    # a bound where the number rises; the first slice needs none
    starts = numbered.groupBy(key, "_no").agg(F.min("_cell").alias("_from")).filter("_no > 0")
    return starts.groupBy(key).agg(F.sort_array(F.collect_list("_from")).alias("_bounds"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    tie: str,
    columns: list[str],
    slice_seconds: int = 86_400 * 30,
    max_age_seconds: int | None = None,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time.

    Equal times are settled by the greatest ``tie``. Time is cut into slices and the
    rows are shuffled on (key, slice), so a hot key spreads over its slices. The newest
    right row of each slice, one row, is carried into the following slices through a
    window over slice summaries only: the number of slices bounds its groups.

    Slices last ``slice_seconds``. With ``bounds`` (from ``depth_bounds``, made with cells of
    ``slice_seconds``) they hold about equally many rows instead, and a small key is one
    slice. A left row without a key or a time has no match and is dealt by its content;
    right rows without one match nothing. Each side is planned once for the rows and once
    for the summaries.
    """
    names = left.columns
    payload = F.struct(
        F.col(right_time).alias("_rt"),
        F.col(tie).alias("_tie"),
        *[F.col(c) for c in columns],
    )

    def sliced(df: DataFrame, time: str) -> DataFrame:
        cell = F.floor(_seconds(time) / slice_seconds).cast("long")
        timed = df.withColumn("_at", F.col(time).cast("timestamp"))
        if bounds is None:
            return timed.withColumn("_slice", cell)
        # fewer rows than ``parts``
        cut = timed.join(F.broadcast(bounds), key, "left").withColumn("_cell", cell)
        # cells ascend and so do bounds: the slice is the number of bounds passed
        passed = F.size(F.filter("_bounds", lambda b: b <= F.col("_cell"))).cast("long")
        number = F.when(F.col("_cell").isNull(), None).when(F.col("_bounds").isNull(), 0).otherwise(passed)
        return cut.withColumn("_slice", number.cast("long")).drop("_bounds", "_cell")

    matchable = F.col(key).isNotNull() & F.col("_slice").isNotNull()
    apart = F.lit(APART) - F.pmod(F.xxhash64(*names), F.lit(APART_SLICES))
    facts = sliced(left, left_time).withColumn("_can", matchable)
    facts = facts.withColumn("_slice", F.when(F.col("_can"), F.col("_slice")).otherwise(apart))
    points = sliced(
        right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
            key, right_time, payload.alias("_hit")
        ),
        right_time,
    )

    last_of_slice = points.groupBy(key, "_slice").agg(F.max("_hit").alias("_hit"))
    wanted = facts.filter("_can").select(key, "_slice").distinct()
    earlier = (
        Window.partitionBy(key)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        wanted.withColumn("_wanted", F.lit(True))
        .join(last_of_slice, [key, "_slice"], "full")
        .withColumn("_carry", F.last("_hit", ignorenulls=True).over(earlier))
        .filter("_wanted AND _carry IS NOT NULL")
        .select(key, "_slice", F.col("_carry").alias("_hit"))
        .withColumn("_at", F.lit(None).cast("timestamp"))
    )
    stacked = (
        facts.withColumn("_is_left", F.lit(1))
        .unionByName(
            points.select(key, "_slice", "_at", "_hit")
            .unionByName(carried)
            .withColumn("_is_left", F.lit(0)),
            allowMissingColumns=True,
        )
    )
    upto = (
        Window.partitionBy(key, "_slice")
        .orderBy(F.col("_at").asc_nulls_first(), "_is_left", F.col("_hit").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    newest = F.last("_hit", ignorenulls=True).over(upto)
    found = stacked.withColumn("_found", newest).filter("_is_left = 1")
    if max_age_seconds is not None:
        age = F.unix_timestamp("_at") - F.unix_timestamp(F.col("_found._rt").cast("timestamp"))
        found = found.withColumn("_found", F.when(age <= max_age_seconds, F.col("_found")))
    return found.select(
        *[F.col(c) for c in names],
        F.col("_found._rt").alias(f"matched_{right_time}"),
        *[F.col(f"_found.{c}").alias(c) for c in columns],
    )
