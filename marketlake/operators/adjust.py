"""Back-adjusted prices without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def back_adjust(
    prices: DataFrame,
    actions: DataFrame | None,
    key: str,
    day: str,
    price: str,
    action_day: str,
    factor: str,
    name: str = "adj_close",
) -> DataFrame:
    """Divide each price by the product of factors of strictly later actions.

    Actions shrink to one factor per key and date first. Prices and actions are then
    stacked and one running product walks each key from its last date back, so a price
    row is never multiplied. A key holds at most two rows per calendar date here.

    A factor that is not positive has no meaning: prices that it would adjust are NULL. A
    price without a key is not adjusted, an action without one adjusts nothing. Such prices
    pass through the same window, so the input is planned once and the result stays
    partitioned by the key; they are one group there, as in every later window by the key.
    """
    if actions is None:
        return prices.withColumn(name, F.col(price))
    per_day = (
        actions.filter(F.col(factor).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key), F.col(action_day).cast("date").alias(day))
        .agg(
            F.product(F.when(F.col(factor) > 0, F.col(factor))).alias("_factor"),
            F.bool_or(F.col(factor) <= 0).alias("_bad"),
        )
        .withColumn("_is_price", F.lit(0))
    )
    # actions first: a union keeps how its parts lie by the key, but not if its first part
    # is a table in buckets
    stacked = per_day.unionByName(prices.withColumn("_is_price", F.lit(1)), allowMissingColumns=True)
    # newest first; on one date the price comes before the action, so that the action
    # leaves the price of its own day alone
    back = (
        Window.partitionBy(key)
        .orderBy(F.col(day).desc(), F.col("_is_price").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    later = F.product(F.coalesce("_factor", F.lit(1.0))).over(back)
    bad = F.coalesce(F.bool_or("_bad").over(back), F.lit(False))
    return (
        stacked.withColumns({"_later": later, "_bad_later": bad})
        .filter("_is_price = 1")
        .withColumn(name, F.when(~F.col("_bad_later"), F.col(price) / F.col("_later")))
        .select(*prices.columns, name)
    )


def back_adjust_as_known(
    prices: DataFrame,
    actions: DataFrame,
    key: str,
    day: str,
    price: str,
    action_day: str,
    factor: str,
    announced: str,
    lag_days: int = 0,
    name: str = "adj_close",
) -> DataFrame:
    """Like ``back_adjust``, but each price uses only actions announced by its own date.

    An action touches exactly the dates from its announcement (less ``lag_days``) up to
    the day before it takes effect. Its factor is switched on at the start of that
    interval and off at the end, and a running product of the switches gives each
    price its factor: again one window and no range join. Factors that are not positive
    and missing keys count as in ``back_adjust``.
    """
    known = F.to_date(announced)
    # a time of day after midnight is known only from the next date on
    first_day = F.date_sub(
        F.when(F.col(announced).cast("timestamp") > known.cast("timestamp"), F.date_add(known, 1))
        .otherwise(known),
        lag_days,
    )
    effective = actions.filter(F.col(factor).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key),
        F.when(F.col(factor) > 0, F.ln(F.when(F.col(factor) > 0, F.col(factor))))
        .otherwise(0.0)
        .alias("_l"),
        F.when(F.col(factor) > 0, 0).otherwise(1).alias("_b"),
        first_day.alias("_from"),
        F.col(action_day).cast("date").alias("_to"),
    ).filter("_from < _to")
    switches = effective.select(
        key,
        F.inline(
            F.array(
                F.struct(F.col("_from").alias(day), F.col("_l").alias("_log"), F.col("_b").alias("_bad")),
                F.struct(F.col("_to").alias(day), (-F.col("_l")).alias("_log"), (-F.col("_b")).alias("_bad")),
            )
        ),
    )
    per_day = (
        switches.groupBy(key, day)
        .agg(F.sum("_log").alias("_log"), F.sum("_bad").alias("_bad"))
        .withColumn("_is_price", F.lit(0))
    )
    stacked = prices.withColumn("_is_price", F.lit(1)).unionByName(per_day, allowMissingColumns=True)
    # oldest first; on one date the switches come before the price
    forward = (
        Window.partitionBy(key)
        .orderBy(day, "_is_price")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # rounding takes away what floating point leaves behind when a factor is switched off
    active = F.exp(F.round(F.sum(F.coalesce("_log", F.lit(0.0))).over(forward), 13))
    bad = F.sum(F.coalesce("_bad", F.lit(0))).over(forward)
    return (
        stacked.withColumns({"_active": active, "_bad_now": bad})
        .filter("_is_price = 1")
        .withColumn(name, F.when(F.col("_bad_now") == 0, F.col(price) / F.col("_active")))
        .drop("_active", "_log", "_bad", "_bad_now", "_is_price")
    )
