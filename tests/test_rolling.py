import statistics

import pytest
from pyspark.sql import functions as F

from marketlake.functions.columns import PRICE_LIMIT_PCT, pct_change, price_limit, relative_change
from marketlake.plans.analytics import (
    build_feat_ticker_daily,
    build_feat_ticker_unified,
    build_ml_ticker_label,
    build_ml_ticker_training,
    build_obt,
)
from tests.conftest import plan_of

N = 25


@pytest.fixture
def fact(spark):
    return spark.range(N).select(
        F.lit("A").alias("ticker_id"),
        F.expr("DATE'2025-01-01' + CAST(id AS INT)").alias("trade_date"),
        (F.lit(100.0) + F.col("id") * F.col("id") % 7).alias("close"),
        (F.lit(100.0) + F.col("id")).alias("adj_close"),
        (F.col("id") + 1).alias("volume"),
        F.lit(10.0).alias("value"),
        F.lit(None).cast("double").alias("foreign_room"),
    )


def closes():
    return [100.0 + i * i % 7 for i in range(N)]


def test_daily_features(fact):
    rows = build_feat_ticker_daily(fact, None).orderBy("trade_date").collect()
    c = closes()
    returns = [(b - a) / a for a, b in zip(c, c[1:])]
    assert all(r.f_ticker_volatility_20d is None for r in rows[:19])
    assert rows[19].f_ticker_volatility_20d == pytest.approx(statistics.stdev(returns[:19]))
    assert rows[24].f_ticker_volatility_20d == pytest.approx(statistics.stdev(returns[4:24]))
    assert rows[4].f_ticker_return_5d is None
    assert rows[5].f_ticker_return_5d == pytest.approx((c[5] - c[0]) / c[0])
    assert rows[2].f_ticker_ma20_gap == pytest.approx(c[2] / (sum(c[:3]) / 3) - 1)
    assert rows[0].f_ticker_foreign_net_ratio_10d is None
    assert dict(build_feat_ticker_daily(fact, None).dtypes)["f_ticker_foreign_net_ratio_10d"] == "double"


def test_foreign_ratio_counts_absent_days_as_zero(fact, frame):
    flow = frame(
        "ticker_id string, trade_date date, foreign_net_value long",
        [("A", "2025-01-01", 20), ("A", "2025-01-03", 5)],
    )
    rows = build_feat_ticker_daily(fact, flow).orderBy("trade_date").collect()
    ratio = [r.f_ticker_foreign_net_ratio_10d for r in rows]
    assert ratio[0] == pytest.approx(2.0) and ratio[2] == pytest.approx(25 / 30)
    assert ratio[12] == 0.0


def test_zero_base_gives_null(frame):
    df = frame("v double, b double", [(1.0, 0.0), (1.0, None), (1.0, 2.0), (1.0, -2.0)])
    got = df.select(relative_change("v", "b").alias("r"), pct_change("v", "b").alias("p")).collect()
    assert [(r.r, r.p) for r in got] == [(None, None), (None, None), (-0.5, -50.0), (-1.5, None)]


def test_price_limits(frame):
    df = frame("e string", [("HOSE",), ("HNX",), ("UPCOM",), (None,)])
    got = [r[0] for r in df.select(price_limit("e")).collect()]
    assert got == [*PRICE_LIMIT_PCT.values(), 7.0]


def test_label_and_training(fact):
    labels = build_ml_ticker_label(fact)
    rows = labels.orderBy("trade_date").collect()
    assert len(rows) == N - 3
    assert str(rows[0].created_ts) == "2025-01-04 15:10:00"
    assert [r.label for r in rows] == [int(100 + i + 3 > (100 + i) * 1.01) for i in range(N - 3)]
    unified = build_feat_ticker_unified(build_feat_ticker_daily(fact, None), None)
    training = build_ml_ticker_training(labels, unified)
    assert training.count() == N - 3
    assert {"label", "f_ticker_return_5d", "f_stream_volume_5m_daily"} <= set(training.columns)
    assert training.filter("created_ts <= event_timestamp").count() == 0


def test_wide_table_without_dimension_or_flow(fact):
    rows = build_obt(fact, None, None).orderBy("trade_date").collect()
    c = closes()
    assert rows[0].pct_change_1d is None and rows[0].price_limit_hit_flag is None
    assert rows[1].pct_change_1d == pytest.approx((c[1] - c[0]) / c[0] * 100)
    assert rows[24].volume_vs_ma20_ratio == pytest.approx(25 / (sum(range(6, 26)) / 20))
    assert rows[3].foreign_net_value is None


def test_features_need_one_shuffle_and_one_sort(fact):
    plan = plan_of(build_feat_ticker_daily(fact, None))
    assert plan.count("Exchange hashpartitioning(ticker_id") <= 1
    assert plan.count("Sort [") == 1
