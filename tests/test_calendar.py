from pyspark.sql import functions as F

from marketlake.functions.calendar import (
    YEARLY,
    date_spine,
    is_trading_day,
    next_trading_days,
    trading_calendar,
)
from marketlake.functions.columns import date_key
from marketlake.plans.dimensions import build_dim_date


def test_trading_days(frame):
    df = frame(
        "d date",
        [("2025-03-03",), ("2025-03-08",), ("2025-03-09",), ("2025-01-01",), ("2025-05-02",), ("2026-02-18",)],
    )
    got = [r[0] for r in df.select(is_trading_day("d")).collect()]
    assert got == [True, False, False, False, False, False]


def test_next_days_skip_weekend_and_holidays(frame):
    df = frame("d date", [("2025-04-29",)])
    days = [str(r.trading_day) for r in next_trading_days(df, "d", 3).orderBy("day_no").collect()]
    assert days == ["2025-04-29", "2025-05-05", "2025-05-06"]


def test_calendar_looks_ahead(frame):
    df = frame("d date", [("2025-03-06",), ("2025-03-10",)])
    rows = {str(r.calendar_date): r for r in trading_calendar(df, "d", 2).collect()}
    assert str(rows["2025-03-06"].next_trading_day) == "2025-03-10"
    assert rows["2025-03-08"].next_trading_day is None


def test_spine_is_dense(frame):
    df = frame("d date", [("2025-01-30",), ("2025-02-02",)])
    assert date_spine(df, "d").count() == 4


def test_date_dimension(frame):
    df = frame("trade_date date", [("2025-01-03",), ("2025-01-03",), ("2025-01-05",), ("2025-01-07",)])
    rows = {str(r.calendar_date): r for r in build_dim_date(df).collect()}
    assert len(rows) == 5
    assert rows["2025-01-03"].date_key == 20250103 and rows["2025-01-03"].holiday_name is None
    assert rows["2025-01-04"].holiday_name == "weekend"
    # an observed weekend trades and is still called a weekend
    assert rows["2025-01-05"].is_trading_day and rows["2025-01-05"].holiday_name == "weekend"
    assert rows["2025-01-06"].holiday_name == "market_holiday"
    assert rows["2025-01-03"].day_of_week == "Friday" and rows["2025-01-03"].quarter == 1


def test_empty_table(frame):
    assert build_dim_date(frame("trade_date date", [])).count() == 0


def test_date_key(frame):
    df = frame("d date", [("2025-12-31",)])
    assert df.select(date_key(F.col("d"))).first()[0] == 20251231


def test_any_number_of_days_is_complete(frame):
    df = frame("d date", [("2025-01-01",)])
    for yearly in ((), YEARLY):
        days = [r.trading_day for r in next_trading_days(df, "d", 5000, yearly=yearly).orderBy("day_no").collect()]
        assert len(days) == 5000 and days == sorted(set(days))
        closed = {(d.month, d.day) for d in days} & set(YEARLY)
        assert not closed if yearly else closed
    assert str(next_trading_days(df, "d", 1).first().trading_day) == "2025-01-02"


def test_yearly_rules_are_an_argument(frame):
    df = frame("d date", [("2026-01-01",), ("2025-09-02",)])
    assert [r[0] for r in df.select(is_trading_day("d")).collect()] == [True, False]
    assert [r[0] for r in df.select(is_trading_day("d", yearly=YEARLY)).collect()] == [False, False]
