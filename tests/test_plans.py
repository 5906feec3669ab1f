import pytest
from pyspark.sql import functions as F

from marketlake import storage
from marketlake.operators import gates
from marketlake.plans import chain, dimensions, facts, lineage, reports
from marketlake.sources import landing
from marketlake.suite.market import Market
from tests.conftest import plan_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark, FOLDER)


def test_daily_chain_end_to_end(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    days = spark.sql("SELECT explode(sequence(DATE'2025-01-01', DATE'2025-01-01' + 59)) AS trade_date")
    bars = days.join(spark.range(10).select(F.concat(F.lit("T"), "id").alias("ticker_id"), "id")).select(
        "ticker_id",
        "trade_date",
        F.lit(10.0).alias("open"),
        F.lit(12.0).alias("high"),
        F.lit(9.0).alias("low"),
        (F.lit(10.0) + (F.xxhash64("ticker_id", "trade_date") % 100) / 100.0).alias("close"),
        F.lit(100).cast("long").alias("volume"),
        F.lit("2025-03-01 10:00").alias("_ingested_at"),
    )
    v1 = bars.withColumn("_schema_version", F.lit(1))
    v2 = bars.filter("trade_date >= DATE'2025-02-01'").withColumns(
        {
            "_schema_version": F.lit(2),
            "value": F.lit(1000.0),
            "foreign_room": F.lit(5.0),
            "_ingested_at": F.lit("2025-03-01 11:00"),
        }
    )
    actions = spark.createDataFrame(
        [("T1", "2025-02-01", "split", 2.0)],
        "ticker_id string, ex_date string, action_type string, ratio double",
    )
    inputs = chain.Inputs([v1, v2], actions=actions)
    paths = chain.run_daily(spark, inputs, root, "2025-03-02 00:00:00", "2025-02-05", writers=4)
    read = {n: spark.read.parquet(p) for n, p in paths.items() if n != "drift_validation_report"}
    assert read["stg_daily_price"].count() == 600
    assert read["stg_daily_price"].filter("_schema_version = 2").count() == 290
    assert read["dim_ticker"].count() == 10
    assert read["dim_date"].count() == 60
    fact = read["fact_daily_price"]
    assert fact.filter("ticker_key IS NULL OR date_key IS NULL").count() == 0
    assert fact.filter("ticker_id = 'T1' AND abs(adj_close - close / 2) < 1e-9").count() == 31
    assert read["obt_ticker_daily_performance"].count() == 600
    assert read["ml_ticker_label"].count() == 570
    training = read["ml_ticker_training"]
    assert training.count() == 570 and any(c.startswith("f_") for c in training.columns)
    assert read["agg_feature_health_daily"].count() == 12
    assert storage.path_exists(spark, paths["drift_validation_report"])
    assert read["dim_industry"].count() == 10


def test_a_landed_drop_runs_through_and_a_missing_key_stops_it(spark, tmp_path):
    land = str(tmp_path / "landing")
    days = spark.sql("SELECT explode(sequence(DATE'2025-01-01', DATE'2025-01-01' + 39)) AS trade_date")
    bars = days.join(spark.range(3).select(F.concat(F.lit("T"), "id").alias("ticker_id"))).select(
        "ticker_id",
        "trade_date",
        *[F.lit(v).alias(c) for c, v in (("open", 10.0), ("high", 12.0), ("low", 9.0), ("close", 11.0))],
        F.lit(100).cast("long").alias("volume"),
    )
    landing.write_landing(bars, land, "2025-03-01", "ohlcv_daily")
    paths = chain.run_landed(spark, land, str(tmp_path / "lake"), "b1", "2025-03-02 00:00:00", "2025-02-05", writers=2)
    fact = spark.read.parquet(paths["fact_daily_price"])
    assert fact.count() == 120 and fact.filter("ticker_key IS NULL").count() == 0
    broken = bars.withColumn("ticker_id", F.when(F.col("ticker_id") != "T1", F.col("ticker_id")))
    landing.write_landing(broken, land, "2025-03-01", "ohlcv_daily")
    with pytest.raises(gates.GateFailure):
        chain.run_landed(spark, land, str(tmp_path / "lake2"), "b1", "2025-03-02 00:00:00", "2025-02-05", writers=2)
    assert not storage.path_exists(spark, str(tmp_path / "lake2" / "stg_daily_price"))


def test_fact_without_dimensions(market):
    fact = facts.build_fact_daily_price(market.staged)
    assert "ticker_key" not in fact.columns
    assert fact.filter("adj_close <> close").count() == 0


def test_dimension_defaults(frame):
    ids = frame("ticker_id string", [(f"{i:03d}",) for i in range(40)])
    rows = dimensions.ticker_attributes(ids, None).orderBy("ticker_id").collect()
    assert [r.is_vn30 for r in rows] == [True] * 30 + [False] * 10
    assert {(r.company_name, r.exchange, r.listing_status) for r in rows} == {("Unknown", "HOSE", "active")}
    reference = frame("ticker_id string, is_active boolean, vn30 boolean", [("000", False, False), ("039", None, True)])
    rows = {r.ticker_id: r for r in dimensions.ticker_attributes(ids, reference).collect()}
    assert rows["000"].listing_status == "inactive" and not rows["000"].is_vn30
    assert rows["039"].is_vn30 and rows["039"].listing_status == "active" and not rows["001"].is_vn30


def test_static_dimensions(spark):
    counts = {n: dimensions.static_dimension(spark, n).count() for n in dimensions.STATIC_DIMENSIONS}
    assert counts == {"dim_industry": 10, "dim_exchange": 3, "dim_session": 4}


def test_lineage(spark):
    pairs = {(r.node, r.upstream): r.depth for r in lineage.closure(lineage.edge_table(spark)).collect()}
    assert pairs["ml_ticker_training", "landing/ohlcv_daily"] == 5
    assert pairs["feat_ticker_unified", "market_events"] == 4
    assert ("stg_trades", "stg_daily_price") not in pairs


def test_cyclic_lineage_is_an_error(frame):
    with pytest.raises(ValueError, match="cyclic"):
        lineage.closure(frame("node string, upstream string", [("a", "b"), ("b", "a")]))


def test_report_text(market, spark):
    df = reports.leaders_by_mean(market.staged, "ticker_id", {"avg_volume": ("volume", 0)}, 3, "1999-06-01")
    assert df.count() == 3
    assert "TakeOrderedAndProject" in plan_of(df)


def test_scan_reads_only_what_a_query_needs(market):
    plan = plan_of(market.tables.ticks().groupBy("ticker_id").agg(F.sum("quantity")))
    scan = plan[plan.index("ReadSchema") :]
    assert "l_extendedprice" not in scan and "l_quantity" in scan


def test_bars_aggregate_by_hash(market):
    plan = plan_of(market.tables.raw_bars())
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_no_unpartitioned_window_over_data(market):
    for df in (market.obt, market.features, market.labels, market.attributes):
        assert "Exchange SinglePartition" not in plan_of(df)


def test_no_cross_join(market):
    for df in (market.obt, market.features, market.dim_date, market.tables.tickers()):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
