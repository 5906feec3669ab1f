import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketlake.session import SESSION_DEFAULTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Small frame from a DDL schema and rows; dates and times may be given as text."""

    def make(schema: str, rows: list[tuple]):
        fields = [f.strip().split() for f in schema.split(",")]
        raw = ", ".join(
            f"{n} {'string' if t in ('date', 'timestamp') else t}" for n, t in fields
        )
        df = spark.createDataFrame(rows, raw)
        for name, kind in fields:
            if kind in ("date", "timestamp"):
                df = df.withColumn(name, df[name].cast(kind))
        return df

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
