import pytest
from pyspark.sql import functions as F

from marketlake import storage
from marketlake.sources import landing, relational
from tests.conftest import plan_of


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_snapshot_replaces_a_table_it_reads(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    storage.write_snapshot(frame("k string, v int", [("a", 1)]), path)
    table = storage.read_table(spark, path)
    storage.write_snapshot(table.withColumn("w", F.col("v") + 1).drop("v"), path)
    assert rows(storage.read_table(spark, path)) == [("a", 2)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        storage.read_table(spark, str(tmp_path / "none"))
    assert storage.read_table_if_present(spark, str(tmp_path / "none")) is None


def test_partition_overwrite_and_pruning(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, trade_date date"
    storage.write_snapshot(frame(schema, [("a", "2025-01-01"), ("b", "2025-01-02")]), path, "trade_date")
    storage.overwrite_partitions(frame(schema, [("c", "2025-01-02")]), path, "trade_date")
    table = storage.read_table(spark, path)
    assert {r.k for r in table.collect()} == {"a", "c"}
    plan = plan_of(table.filter("trade_date = DATE'2025-01-02'"))
    assert "PartitionFilters: [isnotnull(trade_date" in plan


def test_work_dir_follows_the_session(spark):
    assert storage.work_dir(spark, "x") != storage.work_dir(spark, "x")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert storage.work_dir(spark, "x").startswith(shared)


def test_compaction_and_clustering(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(4000).select(
        (F.col("id") % 64).cast("string").alias("ticker_id"),
        F.expr("DATE'2025-01-01' + CAST(id % 61 AS INT)").alias("trade_date"),
        "id",
    )
    df.repartition(16).write.parquet(path)
    assert storage.compact(spark, path) == (16, 1)
    assert storage.read_table(spark, path).count() == 4000
    df.repartition(16).write.mode("overwrite").parquet(path)
    storage.compact(spark, path, cluster_by=["ticker_id", "trade_date"])
    assert rows(storage.read_table(spark, path)) == rows(df)


def test_a_sweep_keeps_partition_folders(spark, tmp_path):
    path = str(tmp_path / "fact_daily_price")
    df = spark.range(600).select(
        (F.col("id") % 7).cast("string").alias("ticker_id"),
        F.expr("DATE'2025-01-01' + CAST(id % 6 AS INT)").alias("trade_date"),
        "id",
    )
    df.repartition(5).write.partitionBy("trade_date").parquet(path)
    assert storage.partition_columns(spark, path) == ["trade_date"]
    before, after = storage.maintain(spark, str(tmp_path))["fact_daily_price"]
    assert after < before and storage.partition_columns(spark, path) == ["trade_date"]
    day = storage.read_table(spark, path).filter("trade_date = DATE'2025-01-02'")
    plan = plan_of(day)
    assert "PartitionFilters: []" not in plan and "trade_date" in plan[plan.index("PartitionFilters") :]
    assert day.count() == 100 and rows(storage.read_table(spark, path).select(*df.columns)) == rows(df)
    storage.overwrite_partitions(df.filter("trade_date = DATE'2025-01-02'").limit(1), path, "trade_date")
    assert storage.read_table(spark, path).count() == 501


def test_maintenance_skips_missing_tables(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "ticker_id").write.parquet(str(tmp_path / "dim_ticker"))
    done = storage.maintain(spark, str(tmp_path))
    assert done["dim_ticker"] is not None and done["fact_daily_price"] is None
    assert len(done) == 6


def test_run_log_and_counts(spark, tmp_path):
    df, seen = storage.counted(spark.range(7), "n")
    df.write.parquet(str(tmp_path / "t"))
    path = str(tmp_path / "log")
    for status in ("success", "failed"):
        storage.append_run_log(spark, path, "p", status, "2025-01-01T00:00:00", "x", seen.get["rows"])
    log = storage.read_table(spark, path)
    assert log.count() == 2 and log.first().input_rows == 7 and log.first().output_rows is None


def test_csv_report(spark, tmp_path):
    storage.export_csv(spark.range(3), str(tmp_path / "r"))
    files = list((tmp_path / "r").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "id"


V2 = "ticker_id string, trade_date date, value double, _schema_version int"


def test_versioned_landing(spark, frame, tmp_path):
    root = str(tmp_path)
    flat = frame("ticker_id string, trade_date date", [("OLD", "2025-01-01")])
    landing.write_landing(flat, root, "2025-07-02", "prices")
    v1 = frame("ticker_id string, trade_date date, _schema_version int", [("A", "2025-06-30", 1)])
    v2 = frame(V2, [("A", "2025-07-01", 5.0, 2)])
    landing.write_versioned_landing({1: v1, 2: v2}, root, "2025-07-02", "prices")
    got = landing.scan_landing(spark, root, "prices")
    assert {"schema_version"} & set(got.columns) == set()
    assert sorted((r.ticker_id, str(r.trade_date), r._schema_version, r.value) for r in got.collect()) == [
        ("A", "2025-06-30", 1, None),
        ("A", "2025-07-01", 2, 5.0),
    ]


def test_several_runs_and_layouts(spark, frame, tmp_path):
    root = str(tmp_path)
    v2 = frame(V2, [("A", "2025-07-01", 5.0, 2)])
    landing.write_versioned_landing({2: v2}, root, "2025-07-02", "prices")
    landing.write_versioned_landing({2: v2}, root, "2025-07-03", "prices")
    landing.write_landing(v2.drop("_schema_version"), root, "2025-07-04", "prices")
    got = landing.scan_landing(spark, root, "prices")
    assert sorted(r.run_date for r in got.collect()) == ["2025-07-02", "2025-07-03", "2025-07-04"]


def test_landing_errors(spark, frame, tmp_path):
    with pytest.raises(FileNotFoundError):
        landing.scan_landing(spark, str(tmp_path), "prices")
    bad = frame("ticker_id string", [("A",)])
    with pytest.raises(ValueError):
        landing.write_versioned_landing({1: bad}, str(tmp_path), "2025-07-02", "prices")


def test_replay_log_rerun_replaces_its_hours(spark, frame, tmp_path):
    path = str(tmp_path / "log")
    df = frame("id string, ts timestamp", [("1", "2025-01-01 09:10:00"), ("2", "2025-01-01 10:00:00")])
    for _ in range(2):
        landing.write_replay_log(df, path, "ts")
    got = landing.read_replay_log(spark, path, "id string, event_date date, event_hour int")
    assert sorted((r.id, r.event_hour) for r in got.collect()) == [("1", 9), ("2", 10)]


def test_reference_json(spark, tmp_path):
    (tmp_path / "r.json").write_text('[\n {"id": "a",\n "n": 1},\n {"id": "b", "n": 2}\n]')
    assert landing.scan_reference_json(spark, str(tmp_path / "r.json")).count() == 2


def test_jdbc_options():
    got = relational.jdbc_options("postgresql://u:p@db:5432/vendor")
    assert got == {"url": "jdbc:postgresql://db:5432/vendor", "user": "u", "password": "p"}
    assert relational.jdbc_options("jdbc:x:y") == {"url": "jdbc:x:y"}


def test_fallback_when_the_database_is_not_there(spark, frame):
    spare = frame("k string", [("a",)])
    got = relational.scan_or_else(
        lambda: relational.scan_relation(spark, "nosuchdb://host/x", "t", "k", (0, 9)), lambda: spare
    )
    assert got is spare
    assert relational.scan_or_else(lambda: spare, lambda: None) is spare
