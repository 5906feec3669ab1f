"""Trading calendar: weekdays that are not holidays."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.columns import as_col, is_weekend

# Closing days of the market.
HOLIDAYS = [
    "2025-01-01",
    "2025-04-30",
    "2025-05-01",
    "2025-09-02",
    "2025-01-28",
    "2025-01-29",
    "2025-01-30",
    "2025-01-31",
    "2025-04-07",
    "2026-02-16",
    "2026-02-17",
    "2026-02-18",
    "2026-02-19",
    "2026-04-26",
    "2025-05-02",
]

# Month and day of holidays that fall on the same date every year, for calendars beyond
# the years of the list.
YEARLY = ((1, 1), (4, 30), (5, 1), (9, 2))


def is_holiday(
    day: str | Column, holidays: Sequence[str] = HOLIDAYS, yearly: Sequence[tuple[int, int]] = ()
) -> Column:
    """Listed days, and days of the given months and days in any year."""
    day = as_col(day)
    listed = F.date_format(day, "yyyy-MM-dd").isin(list(holidays))
    if not yearly:
        return listed
    return listed | (F.month(day) * 100 + F.dayofmonth(day)).isin([m * 100 + d for m, d in yearly])


def is_trading_day(
    day: str | Column, holidays: Sequence[str] = HOLIDAYS, yearly: Sequence[tuple[int, int]] = ()
) -> Column:
    return ~is_weekend(day) & ~is_holiday(day, holidays, yearly)


def date_spine(df: DataFrame, day: str, name: str = "calendar_date", extra_days: int = 0) -> DataFrame:
    """One row per calendar date between the bounds seen in ``df``."""
    bounds = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return bounds.select(
        F.explode(F.sequence("lo", F.date_add("hi", extra_days))).alias(name)
    )


def _reach(steps: int, holidays: Sequence[str], yearly: Sequence[tuple[int, int]]) -> int:
    """Calendar days that hold ``steps`` trading days from any start.

    D days have 5 in 7 weekdays, less 5 for broken weeks, less at most all listed
    holidays and each yearly one as often as its date comes up.
    """
    rate = 5 / 7 - len(yearly) / 365
    if rate <= 0:
        raise ValueError("too many yearly holidays")
    return ceil((steps + 5 + len(holidays) + len(yearly)) / rate)


def trading_calendar(
    df: DataFrame,
    day: str,
    steps: int,
    holidays: Sequence[str] = HOLIDAYS,
    yearly: Sequence[tuple[int, int]] = (),
) -> DataFrame:
    """Calendar over the dates of ``df`` with the trading day ``steps`` sessions ahead.

    The window runs over calendar dates, a few hundred rows a year, and never over
    the data itself.
    """
    spine = date_spine(df, day, extra_days=steps * 7 + 14).withColumn(
        "is_trading_day", is_trading_day("calendar_date", holidays, yearly)
    )
    trading = spine.filter("is_trading_day").select(
        "calendar_date",
        F.lead("calendar_date", steps)
        .over(Window.partitionBy(F.lit(1)).orderBy("calendar_date"))
        .alias("next_trading_day"),
    )
    return spine.join(trading, "calendar_date", "left")


def next_trading_days(
    df: DataFrame,
    start: str,
    n_days: int,
    holidays: Sequence[str] = HOLIDAYS,
    yearly: Sequence[tuple[int, int]] = (),
) -> DataFrame:
    """The first ``n_days`` trading days on or after each start date, as one row each."""
    until = F.date_add(start, _reach(n_days, holidays, yearly))
    days = F.filter(
        F.sequence(F.col(start), until), lambda day: is_trading_day(day, holidays, yearly)
    )
    return df.select("*", F.posexplode(F.slice(days, 1, n_days)).alias("day_no", "trading_day"))
