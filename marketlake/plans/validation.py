"""Gates of each layer, as one report; ``gates.require`` turns a report into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from marketlake.contracts import REGISTRY
from marketlake.operators import gates
from marketlake.operators.contract import check_tables
from marketlake.operators.shape import bar_rules

GRAIN = ["ticker_id", "trade_date"]


def contract_findings(tables: dict[str, DataFrame], rows: bool = False) -> DataFrame:
    """Findings for stored tables given under the titles of their contracts."""
    return check_tables([(df, REGISTRY[title]) for title, df in tables.items()], rows)


def raw_gates(tables: dict[str, DataFrame]) -> DataFrame:
    """Required keys of the raw tables, as far as a table has them."""
    checks = [
        gates.nulls(df, keys, name)
        for name, df in tables.items()
        if (keys := [c for c in GRAIN if c in df.columns])
    ]
    return reduce(DataFrame.unionByName, checks)


def staged_gates(prices: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """Grain of the staged tables; weekend dates and domain failures as warnings."""
    checks = [
        gates.uniqueness(prices, GRAIN, "stg_daily_price"),
        gates.weekend_dates(prices, "trade_date", "stg_daily_price"),
        gates.domain(prices, list(bar_rules()), "stg_daily_price"),
    ]
    if flow is not None:
        checks.append(gates.uniqueness(flow, GRAIN, "stg_foreign_flow"))
    return reduce(DataFrame.unionByName, checks)


def fact_gates(fact: DataFrame, dim_ticker: DataFrame) -> DataFrame:
    """References, looked-up keys and open versions."""
    checks = [
        gates.referential(fact, dim_ticker, "ticker_id", "fact_daily_price"),
        gates.single_current(dim_ticker, "ticker_id", "dim_ticker"),
    ]
    keys = [c for c in ("ticker_key", "date_key") if c in fact.columns]
    if keys:
        checks.append(gates.nulls(fact, keys, "fact_daily_price"))
    return reduce(DataFrame.unionByName, checks)


def feature_gates(features: DataFrame, labels: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Times of features and labels; drift as a warning."""
    checks = [
        gates.nulls(features, ["event_timestamp", "created_ts"], "feat_ticker_daily"),
        gates.time_order(labels, "event_timestamp", "created_ts", "ml_ticker_label"),
    ]
    if health is not None:
        checks.append(gates.drift(health))
    return reduce(DataFrame.unionByName, checks)
