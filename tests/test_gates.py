import pytest
from pyspark.sql import functions as F

from marketlake.operators import gates, profile


def row(df):
    r = df.first()
    return r.checked, r.failed, r.status


def test_uniqueness_and_duplicates(frame):
    df = frame("a string, b int", [("x", 1), ("x", 1), ("y", 1)])
    assert row(gates.uniqueness(df, ["a", "b"], "t")) == (3, 1, "failed")
    assert row(gates.uniqueness(df.distinct(), ["a", "b"], "t")) == (2, 0, "passed")
    assert row(gates.uniqueness(df.filter("false"), ["a"], "t")) == (0, 0, "passed")
    assert gates.duplicates(df, ["a", "b"], "t").first().rate_pct == pytest.approx(100 / 3)


def test_nulls(frame):
    df = frame("a string, b int", [("x", None), (None, None), ("y", 1)])
    got = {r.subject: r.failed for r in gates.nulls(df, ["a", "b"], "t").collect()}
    assert got == {"t.a": 1, "t.b": 2}


def test_referential_counts_null_keys(frame):
    facts = frame("k string", [("a",), ("a",), ("z",), (None,)])
    dim = frame("k string", [("a",), ("b",)])
    assert row(gates.referential(facts, dim, "k", "t")) == (3, 2, "failed")
    assert {r.k for r in gates.missing_keys(facts, dim, "k").collect()} == {"z", None}


def test_calendar_gates(frame):
    facts = frame("d date", [("2025-01-04",), ("2025-01-06",), ("2025-01-06",)])
    cal = frame(
        "calendar_date date, is_trading_day boolean",
        [("2025-01-04", False), ("2025-01-06", True), ("2025-01-07", True)],
    )
    assert row(gates.weekend_dates(facts, "d", "t")) == (2, 1, "warning")
    got = {r.gate: (r.checked, r.failed) for r in gates.calendar_match(facts, "d", cal, "t").collect()}
    assert got == {"closed_day_facts": (2, 1), "missing_trading_days": (2, 1)}


def test_cardinality(frame):
    df = frame("k string, d date", [("a", "2025-01-01"), ("a", "2025-01-01"), ("b", "2025-01-01")])
    assert tuple(gates.cardinality(df, "k", "d").first()) == (2, 2, True, True)
    assert tuple(gates.cardinality(df.filter("false"), "k", "d").first()) == (0, 0, True, True)


def test_single_current_and_time_order(frame):
    dim = frame("k string, is_current boolean", [("a", True), ("a", True), ("b", False), ("b", True)])
    assert row(gates.single_current(dim, "k", "dim")) == (2, 1, "failed")
    df = frame("e timestamp, c timestamp", [("2025-01-01", "2025-01-02"), ("2025-01-01", None)])
    assert row(gates.time_order(df, "e", "c", "t")) == (2, 1, "failed")


def test_price_limit_and_domain(frame):
    df = frame("x string, c double", [("A", 8.0), ("A", -6.0), ("B", None)])
    got = {r.subject: r.failed for r in gates.price_limit_breaks(df, "c", F.lit(7.0), "x", 0.01).collect()}
    assert got == {"A": 1, "B": 0}
    flags = frame("f boolean, g boolean", [(True, True), (False, None), (True, None)])
    assert row(gates.domain(flags, ["f", "g"], "t")) == (3, 1, "warning")


def test_require_raises_only_for_blocking_gates(frame):
    df = frame("a string, d date", [("x", "2025-01-04"), ("x", "2025-01-04")])
    gates.require(gates.weekend_dates(df, "d", "t"))
    with pytest.raises(gates.GateFailure, match="uniqueness"):
        gates.require(gates.weekend_dates(df, "d", "t"), gates.uniqueness(df, ["a"], "t"))


def test_label_balance(frame):
    df = frame("label int", [(1,), (0,), (0,), (1,)])
    assert tuple(gates.label_balance(df, "label").first()) == (4, 2, 2, 50.0)


def test_reconcile(frame):
    trades = frame(
        "ticker_id string, trade_date date, quantity long, price double, seq int",
        [("A", "2025-01-02", 5, 10.0, 1), ("A", "2025-01-02", 7, 11.0, 2), ("B", "2025-01-02", 1, 1.0, 1)],
    )
    bars = frame(
        "ticker_id string, trade_date date, volume long, low double, high double, close double",
        [("A", "2025-01-02", 12, 10.0, 11.0, 11.0), ("C", "2025-01-02", 1, 1.0, 1.0, 1.0)],
    )
    got = {r.ticker_id: tuple(r)[4:] for r in profile.reconcile(trades, bars, "seq").collect()}
    assert got["A"] == (True, True, True)
    assert got["B"] == (None, None, None) and got["C"] == (None, None, None)


def test_event_profile(frame):
    df = frame(
        "id string, e timestamp, c timestamp",
        [
            ("1", "2025-01-01 10:00:01", "2025-01-01 10:00:01"),
            ("1", "2025-01-01 10:00:01", "2025-01-01 10:02:01"),
            ("2", "2025-01-01 10:01:00", "2025-01-01 10:01:00"),
        ],
    )
    got = {r.metric: r.value for r in profile.event_profile(df, "id", "e", "c").collect()}
    assert (got["events"], got["late_events"], got["duplicate_events"]) == (3, 1, 1)
    assert (got["peak_per_minute"], got["average_per_minute"]) == (2, 1.5)
