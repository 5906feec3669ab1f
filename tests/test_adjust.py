import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake.operators.adjust import back_adjust, back_adjust_as_known
from marketlake.plans.facts import price_factors
from tests.conftest import plan_of

PRICES = "t string, d date, close double"
ACTIONS = "t string, x date, f double"


def adjust(prices, actions):
    return back_adjust(prices, actions, "t", "d", "close", "x", "f")


def test_strictly_later_actions_multiply(frame):
    prices = frame(PRICES, [("A", f"2025-01-0{i}", 100.0) for i in (1, 2, 3)] + [("B", "2025-01-01", 7.0)])
    actions = frame(
        ACTIONS, [("A", "2025-01-02", 2.0), ("A", "2025-01-03", 1.1), ("A", "2025-01-03", 1.5)]
    )
    out = {(r.t, str(r.d)): r.adj_close for r in adjust(prices, actions).collect()}
    assert out["A", "2025-01-03"] == 100.0
    assert out["A", "2025-01-02"] == pytest.approx(100 / 1.65)
    assert out["A", "2025-01-01"] == pytest.approx(100 / 3.3)
    assert out["B", "2025-01-01"] == 7.0


def test_without_actions(frame):
    prices = frame(PRICES, [("A", "2025-01-01", 100.0)])
    assert adjust(prices, None).first().adj_close == 100.0
    assert adjust(prices, frame(ACTIONS, [])).first().adj_close == 100.0


def test_factor_of_each_action_type(frame):
    actions = frame(
        "ticker_id string, ex_date date, action_type string, ratio double",
        [
            ("A", "2025-01-01", "split", 2.0),
            ("A", "2025-01-02", "stock_dividend", 0.1),
            ("A", "2025-01-03", "cash_dividend", 0.5),
        ],
    )
    factors = [r.factor for r in price_factors(actions).orderBy("action_date").collect()]
    assert factors == [2.0, 1.1, None]


def test_matches_the_plain_range_join(spark, frame):
    rng = random.Random(5)
    days = [f"2025-{m:02d}-{d:02d}" for m in (1, 2) for d in range(1, 29)]
    prices = frame(PRICES, [(t, d, rng.uniform(1, 99)) for t in "ABC" for d in days])
    actions = frame(ACTIONS, [(rng.choice("ABC"), rng.choice(days), rng.uniform(1, 2)) for _ in range(60)])
    plain = (
        prices.alias("p")
        .join(actions.alias("a"), F.expr("p.t = a.t AND a.x > p.d"), "left")
        .groupBy("p.t", "p.d", "p.close")
        .agg((F.col("p.close") / F.coalesce(F.product("f"), F.lit(1.0))).alias("adj"))
    )
    want = {(r.t, r.d): r.adj for r in plain.collect()}
    got = {(r.t, r.d): r.adj_close for r in adjust(prices, actions).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_only_announced_actions_count(frame):
    prices = frame(PRICES, [("A", f"2025-01-0{i}", 100.0) for i in range(1, 8)])
    actions = frame(
        "t string, x date, f double, known timestamp",
        [
            ("A", "2025-01-06", 2.0, "2025-01-03 00:00:00"),
            ("A", "2025-01-05", 1.5, "2025-01-03 08:00:00"),
            ("A", "2025-01-04", 9.0, "2025-01-04 00:00:00"),
        ],
    )
    out = back_adjust_as_known(prices, actions, "t", "d", "close", "x", "f", "known")
    got = [r.adj_close for r in out.orderBy("d").collect()]
    assert got == pytest.approx([100, 100, 50, 100 / 3, 50, 100, 100])
    assert got[-1] == 100.0


def test_bad_factors_and_missing_keys_in_both_variants(frame):
    prices = frame(
        "k string, d date, p double",
        [("a", "2025-01-01", 10.0), ("a", "2025-01-05", 10.0), ("b", "2025-01-01", 10.0), (None, "2025-01-01", 10.0)],
    )
    actions = frame(
        "k string, ex date, f double, known date",
        [("a", "2025-01-03", 0.0, "2024-12-01"), ("b", "2025-01-03", 2.0, "2024-12-01"), (None, "2025-01-03", 5.0, "2024-12-01")],
    )
    one = back_adjust(prices, actions, "k", "d", "p", "ex", "f")
    other = back_adjust_as_known(prices, actions, "k", "d", "p", "ex", "f", "known")
    want = {("a", "2025-01-01"): None, ("a", "2025-01-05"): 10.0, ("b", "2025-01-01"): 5.0, (None, "2025-01-01"): 10.0}
    for df in (one, other):
        assert df.columns == ["k", "d", "p", "adj_close"]
        got = {(r.k, str(r.d)): r.adj_close for r in df.collect()}
        assert {k: v and round(v, 6) for k, v in got.items()} == want


def test_prices_are_planned_once_and_stay_partitioned_by_key(spark, tmp_path):
    spark.range(200).selectExpr(
        "cast(if(id % 9 = 0, null, id % 7) as string) k", "date_add(date'2025-01-01', cast(id as int)) d", "id * 1.0D p"
    ).write.parquet(f"{tmp_path}/prices")
    spark.range(20).selectExpr(
        "cast(id % 7 as string) k", "date_add(date'2025-02-01', cast(id as int)) ex", "2.0D f", "date'2025-01-20' known"
    ).write.parquet(f"{tmp_path}/actions")
    prices, actions = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("prices", "actions"))
    after = Window.partitionBy("k").orderBy("d")
    for df in (
        back_adjust(prices, actions, "k", "d", "p", "ex", "f"),
        back_adjust_as_known(prices, actions, "k", "d", "p", "ex", "f", "known"),
    ):
        known = df.withColumn("before", F.lag("adj_close").over(after))
        optimized = known._jdf.queryExecution().optimizedPlan().toString()
        assert optimized.count("Relation [k#") == 2  # prices and actions, each once
        plan = plan_of(known)
        adjusted = plan[: plan.index("Union")]
        # one shuffle by key serves the adjustment and the window after it
        assert adjusted.count("Exchange hashpartitioning(k#") == 1
        assert known.count() == 200
