"""Reusable column expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Daily price limit in percent by exchange, and the fallback.
PRICE_LIMIT_PCT = {"HOSE": 7.0, "HNX": 10.0, "UPCOM": 15.0}
DEFAULT_PRICE_LIMIT_PCT = 7.0

# Upper bounds of the drift severity bands.
SEVERITY_BANDS = [("baseline", 0.05), ("detected", 0.15), ("strong", 0.20)]
TOP_SEVERITY = "alert"

# Fixed value: PSI above this raises an alert.
PSI_ALERT = 0.15


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pct_change(value: str | Column, base: str | Column) -> Column:
    """Percent change, NULL when the base is NULL or not positive."""
    value, base = as_col(value), as_col(base)
    return F.when(base > 0, (value - base) / base * 100)


def relative_change(value: str | Column, base: str | Column) -> Column:
    """Fractional change, NULL instead of an error on a zero base."""
    value, base = as_col(value), as_col(base)
    return F.try_divide(value - base, base)


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio defined only over a positive denominator."""
    return F.when(denominator > 0, numerator / denominator)


def price_limit(exchange: str | Column) -> Column:
    """Daily price limit in percent for an exchange code."""
    exchange = as_col(exchange)
    rule = None
    for code, limit in PRICE_LIMIT_PCT.items():
        start = F.when if rule is None else rule.when
        rule = start(exchange == code, F.lit(limit))
    return rule.otherwise(F.lit(DEFAULT_PRICE_LIMIT_PCT))


def severity_band(psi: str | Column) -> Column:
    """Map a PSI value to its severity name."""
    psi = as_col(psi)
    rule = None
    for name, upper in SEVERITY_BANDS:
        start = F.when if rule is None else rule.when
        rule = start(psi < upper, F.lit(name))
    return rule.otherwise(F.lit(TOP_SEVERITY))


def action_factor(action_type: str | Column, ratio: str | Column) -> Column:
    """Price factor of a corporate action; NULL for types that leave prices alone."""
    action_type, ratio = as_col(action_type), as_col(ratio)
    return F.when(action_type == "split", ratio).when(
        action_type == "stock_dividend", F.lit(1.0) + ratio
    )


def date_key(day: str | Column) -> Column:
    """Calendar date as a yyyyMMdd integer."""
    day = as_col(day)
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def is_weekend(day: str | Column) -> Column:
    return F.dayofweek(as_col(day)).isin(1, 7)


def arrival_delay_exceeds(event_ts: str | Column, arrival_ts: str | Column, seconds: int) -> Column:
    """True when whole seconds between event and arrival pass the limit; NULL times pass."""
    delay = F.unix_timestamp(as_col(arrival_ts)) - F.unix_timestamp(as_col(event_ts))
    return F.coalesce(delay > seconds, F.lit(False))
