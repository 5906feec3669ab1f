"""Trading-time features: every window counts rows of a key, not calendar days.

All of them share one partitioning and ordering, so one shuffle and one sort serve
the lot. The input has one row per key and date, so a key's group is bounded by the
number of dates, whatever the volume of ticks behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Series:
    """Ordered rows of each key."""

    def __init__(self, key: str, order: str):
        self.window = Window.partitionBy(key).orderBy(order)

    def back(self, rows: int):
        return self.window.rowsBetween(-(rows - 1), 0)

    def lag(self, value: str, rows: int = 1) -> Column:
        return F.lag(value, rows).over(self.window)

    def lead(self, value: str, rows: int) -> Column:
        return F.lead(value, rows).over(self.window)

    def mean(self, value: str, rows: int) -> Column:
        """Moving average; shorter frames at the start of a series count too."""
        return F.avg(value).over(self.back(rows))

    def total(self, value: Column, rows: int) -> Column:
        return F.sum(value).over(self.back(rows))

    def deviation(self, value: str, rows: int) -> Column:
        """Sample deviation of the last ``rows`` values, NULL before the frame is full."""
        full = F.row_number().over(self.window) >= rows
        return F.when(full, F.stddev_samp(value).over(self.back(rows)))


def future_label(
    df: DataFrame,
    key: str,
    order: str,
    price: str,
    horizon: int,
    rise: float,
) -> DataFrame:
    """Label 1 when the price ``horizon`` rows ahead beats today's by the factor ``rise``.

    Adds the future price and the date it becomes known; rows without a future price
    are left out.
    """
    series = Series(key, order)
    return (
        df.withColumn("_future", series.lead(price, horizon))
        .withColumn("label_available_date", series.lead(order, horizon))
        .filter("_future IS NOT NULL")
        .withColumn("label", (F.col("_future") > F.col(price) * rise).cast("int"))
        .drop("_future")
    )
