"""Plans and sizes that keep a task's share bounded as tables grow."""

import re

from pyspark.sql import functions as F

from marketlake import storage
from marketlake.operators import skew
from marketlake.plans import bucketed
from marketlake.session import small_splits
from marketlake.suite import live
from marketlake.suite.market import Market
from marketlake.suite.registry import QUERIES
from tests.conftest import plan_of

FOLDER = "/root/testdata/sf0.001"


def test_rescaled_rows_are_not_shuffled_by_group(frame):
    df = frame("k string, volume long", [("a", 1), ("a", 2), ("b", 3), (None, 4)])
    scaled = skew.to_target_share(df, "k", "volume", {"a": 80, "b": 10})
    joins = re.findall(r"(\w+Join|CartesianProduct)\b", plan_of(scaled))
    assert joins == ["BroadcastHashJoin"]


def test_clustering_sorts_in_bounded_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(600_000).select(F.xxhash64("id").alias("ticker_id"), F.xxhash64("id", F.lit(1)).alias("v"))
    rows.write.parquet(path)
    size = storage.file_stats(spark, path)[1]
    storage.compact(spark, path, cluster_by=["ticker_id"], sort_mb=2)
    assert storage.file_stats(spark, path)[0] == -(-size // (2 << 20)) > 1
    assert spark.read.parquet(path).count() == 600_000


def test_buckets_follow_the_rows():
    assert bucketed.buckets_for(1_000) == 8
    assert bucketed.buckets_for(40_000_000) == 80


def test_fact_shuffles_bars_twice_and_reads_them_once(spark):
    plan = plan_of(QUERIES["fact_daily_price"](spark, FOLDER))
    assert plan.count("l_extendedprice") and len(re.findall(r"FileScan parquet \[[^]]*l_extendedprice", plan)) == 1
    window = plan[plan.index("Window [product") :]
    assert window.index("Union") < window.index("Exchange")


def test_calendar_of_prints_is_that_of_staged_prices(spark):
    market = Market(spark, FOLDER)
    own = market.tables.ticks().select("trade_date").distinct()
    assert sorted(own.collect()) == sorted(market.staged.select("trade_date").distinct().collect())


def test_splits_are_bounded(spark):
    session = small_splits(spark.newSession())
    assert session.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    assert session.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
    session.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    assert small_splits(session).conf.get("spark.sql.files.maxPartitionBytes") == "1m"


def test_deliveries_parse_each_event_once(spark, monkeypatch):
    seen = []

    def parse(rows):
        seen.append(rows.count())
        return parse_events(rows)

    parse_events = live.parse_events
    monkeypatch.setattr(live, "parse_events", parse)
    market = Market(spark, FOLDER)
    live._two_deliveries(market)
    assert sum(seen) == market.tables.raw_events().count()
