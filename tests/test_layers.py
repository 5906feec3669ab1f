import pytest
from pyspark.sql import functions as F

from marketlake.operators import gates
from marketlake.operators.contract import ContractViolation
from marketlake.plans import reports, staging, validation
from marketlake.sources import landing
from marketlake.suite.market import Market
from tests.conftest import plan_of

V1 = "ticker_id string, trade_date date, open double, high double, low double, close double, volume long, _schema_version int"
ROW = ("A", "2025-06-30", 1.0, 2.0, 0.5, 1.5, 10)


@pytest.fixture(scope="module")
def market(spark):
    return Market(spark, "/root/testdata/sf0.001")


def drop(frame, extra="", value=()):
    v1 = frame(V1, [ROW + (1,)])
    v2 = frame(V1 + ", value double, foreign_room double" + extra, [ROW + (2, 15.0, 1.0) + value])
    return {1: v1, 2: v2}


def test_ingest_landing(spark, frame, tmp_path):
    land, root = str(tmp_path / "landing"), str(tmp_path / "raw")
    landing.write_versioned_landing(drop(frame), land, "2025-07-02", "ohlcv_daily")
    actions = frame("action_id string, ticker_id string", [("1", "A")])
    landing.write_landing(actions, land, "2025-07-02", "corporate_actions")
    paths = staging.ingest_landing(spark, land, root, "b7")
    assert set(paths) == {"raw_ohlcv_daily_v1", "raw_ohlcv_daily_v2", "raw_corporate_actions"}
    raw = {n: spark.read.parquet(p) for n, p in paths.items()}
    assert raw["raw_ohlcv_daily_v2"].first()._batch_id == "b7"
    staged = staging.stage_daily_price([raw["raw_ohlcv_daily_v1"], raw["raw_ohlcv_daily_v2"]])
    assert staged.count() == 1


def test_ingest_writes_nothing_on_a_violation(spark, frame, tmp_path):
    land, root = str(tmp_path / "landing"), tmp_path / "raw"
    versions = {2: drop(frame, ", surprise string", ("x",))[2]}
    landing.write_versioned_landing(versions, land, "2025-07-02", "ohlcv_daily")
    with pytest.raises(ContractViolation, match="surprise"):
        staging.ingest_landing(spark, land, str(root), "b7")
    assert not root.exists()


def test_unknown_versions_raise_and_flat_drops_are_told_by_their_columns(spark, frame, tmp_path):
    land, root = str(tmp_path / "landing"), str(tmp_path / "raw")
    versions = drop(frame)
    landing.write_landing(versions[1].drop("_schema_version"), land, "2025-07-01", "ohlcv_daily")
    landing.write_landing(versions[2].drop("_schema_version"), land, "2025-07-02", "ohlcv_daily")
    paths = staging.ingest_landing(spark, land, root, "b1")
    assert {n: spark.read.parquet(p).count() for n, p in paths.items()} == {
        "raw_ohlcv_daily_v1": 1,
        "raw_ohlcv_daily_v2": 1,
    }
    one_day = staging.ingest_landing(spark, land, f"{root}-day", "b1", run_date="2025-07-02")
    assert set(one_day) == {"raw_ohlcv_daily_v2"}
    later = versions[2].withColumn("_schema_version", F.lit(3))
    landing.write_versioned_landing({1: versions[1], 3: later}, land, "2025-07-03", "ohlcv_daily")
    with pytest.raises(ValueError, match="3"):
        staging.ingest_landing(spark, land, f"{root}-again", "b1")


def test_a_landing_of_many_run_dates_is_pruned(spark, frame, tmp_path):
    land = str(tmp_path / "landing")
    for day in ("2025-07-02", "2025-07-03"):
        landing.write_versioned_landing(drop(frame), land, day, "ohlcv_daily")
    df = landing.scan_landing(spark, land, "ohlcv_daily")
    assert dict(df.dtypes)["run_date"] == "string" and df.count() == 4
    version_2 = plan_of(df.filter("_schema_version = 2"))
    assert "schema_version" in version_2.split("PartitionFilters")[1].split("PushedFilters")[0]
    one_day = df.filter("run_date = '2025-07-03'")
    assert one_day.count() == 2 and plan_of(one_day).count("FileScan") == 1
    day = landing.scan_landing(spark, land, "ohlcv_daily", run_date="2025-07-03")
    assert len(day.inputFiles()) == 2 and day.count() == 2


def test_ingest_of_an_empty_landing(spark, tmp_path):
    assert staging.ingest_landing(spark, str(tmp_path), str(tmp_path / "raw"), "b") == {}


def test_layer_gates(market):
    report = gates.require(
        validation.raw_gates({"raw_ohlcv_daily": market.tables.raw_bars()}),
        validation.staged_gates(market.staged, market.flow),
        validation.fact_gates(market.fact, market.dim_ticker),
        validation.feature_gates(market.features, market.labels),
    )
    assert report.filter("status <> 'passed' AND gate <> 'weekend'").count() == 0
    assert report.select("gate").distinct().count() == 7


def test_contract_findings(market):
    found = validation.contract_findings({"dim_ticker.v1": market.dim_ticker})
    assert found.count() == 0
    broken = validation.contract_findings({"dim_ticker.v1": market.dim_ticker.drop("is_vn30")})
    assert [r.column_name for r in broken.collect()] == ["is_vn30"]
    rows = validation.contract_findings({"dim_ticker.v1": market.dim_ticker}, rows=True)
    assert rows.filter("rows > 0").count() == 0


def test_catalogue(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "dim_things"))
    assert reports.register_tables(spark, str(tmp_path), ["dim_things", "absent"]) == ["dim_things"]
    assert "dim_things" in reports.list_tables(spark)
    assert reports.describe(spark, "dim_things").first().col_name == "id"
