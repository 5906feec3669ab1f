import pytest
from pyspark.sql import functions as F

from marketlake.operators import skew


@pytest.fixture
def big(spark):
    # two thirds of the rows share one key, some have none
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot"))
        .when(F.col("id") % 50 == 2, F.lit(None))
        .otherwise((F.col("id") % 40).cast("string"))
        .alias("k"),
        F.col("id"),
    )


@pytest.fixture
def small(frame):
    return frame("k string, w int", [("hot", 2), ("hot", 3), ("5", 1), ("gone", 9)])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_a_plain_join(big, small, how):
    got = skew.salted_join(big, small, "k", ["id"], how, salts=7, hot_share=0.1)
    want = big.join(small, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salted_join_rejects_other_joins(big, small):
    with pytest.raises(ValueError):
        skew.salted_join(big, small, "k", ["id"], "full")


def test_hot_keys_are_few(big):
    assert skew.hot_keys(big, "k", 0.1) == ["hot"]


def test_salted_agg_equals_a_plain_one(big):
    got = skew.salted_agg(
        big, "k", ["id"], {"n": F.count("*"), "m": F.max("id")}, {"n": F.sum("n"), "m": F.max("m")}
    )
    want = big.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_amplify(frame):
    df = frame("k string", [("a",), ("b",)])
    rows = skew.amplify(df, F.col("k") == "a", "k", "HOT", 2, 3).collect()
    assert sum(r.partition_key == "HOT" for r in rows) == 6
    assert sum(r.partition_key == "b" for r in rows) == 2


def test_target_shares_are_exact(frame):
    df = frame("k string, volume long", [("a", 1000), ("a", 3), ("b", 500), (None, 7), ("z", 0)])
    rows = skew.to_target_share(df, "k", "volume", {"a": 80, "b": 10, "z": 5}).collect()
    out = sorted(((r.k or "", r.volume) for r in rows))
    assert out == sorted([("a", 1000 * 1510 * 80 // 100300), ("a", 3 * 1510 * 80 // 100300), ("b", 151), ("", 7), ("z", 0)])
