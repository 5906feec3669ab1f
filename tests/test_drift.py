import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlake.operators import drift


def numpy_psi(expected, actual, bins=10):
    expected, actual = (np.asarray(x)[~np.isnan(x)] for x in (expected, actual))
    both = np.concatenate([expected, actual])
    if len(both) < 2 * bins:
        return 0.0
    edges = np.histogram_bin_edges(both, bins=bins)
    e, a = np.histogram(expected, edges)[0], np.histogram(actual, edges)[0]
    e, a = e / max(e.sum(), 1) + 1e-6, a / max(a.sum(), 1) + 1e-6
    return max(0.0, float(np.sum((a - e) * np.log(a / e))))


def run(spark, expected, actual):
    base = spark.createDataFrame([(float(v),) for v in expected], "f double")
    now = spark.createDataFrame([("g", float(v)) for v in actual], "day string, f double")
    rows = drift.psi(
        drift.long_features(base, [], ["f"]), drift.long_features(now, ["day"], ["f"]), "day", slices=4
    ).collect()
    return rows[0].psi if rows else 0.0


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (0.7, 1.0), (0.0, 2.5), (40.0, 1.0)])
def test_matches_a_histogram(spark, shift, scale):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=800), rng.normal(shift, scale, size=300)
    assert run(spark, a, b) == pytest.approx(numpy_psi(a, b), rel=1e-9)


def test_identical_tiny_and_constant(spark):
    values = np.linspace(0, 1, 200)
    assert run(spark, values, values) == pytest.approx(0.0, abs=1e-12)
    assert run(spark, [1.0, 2.0], [3.0, 4.0]) == 0.0
    assert run(spark, [5.0] * 30, [5.0] * 30) == pytest.approx(0.0, abs=1e-12)


def test_nan_and_null_are_ignored(spark):
    values = list(np.linspace(0, 1, 100))
    assert run(spark, values + [float("nan")] * 50, values) == pytest.approx(0.0, abs=1e-12)


def test_monitoring_dates(spark):
    days = spark.sql(
        "SELECT explode(sequence(DATE'2025-07-01', DATE'2025-07-01' + 60)) AS d"
    )
    roles = drift.monitoring_dates(days, "d", "2025-08-10").collect()
    base = sorted(str(r.d) for r in roles if r.role == "baseline")
    watched = sorted(str(r.d) for r in roles if r.role == "monitored")
    assert len(base) == 30 and base[0] == "2025-07-11" and base[-1] == "2025-08-09"
    assert watched == ["2025-08-10", "2025-08-20", "2025-08-30"]


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        for t in range(12):
            wide = 3.0 if i >= 40 else 1.0
            rows.append((i, f"t{t}", float(rng.normal(0, wide)), float(rng.normal())))
    df = spark.createDataFrame(rows, "i int, ticker_id string, f_a double, f_b double")
    return df.withColumn("trade_date", F.expr("DATE'2025-01-01' + i")).drop("i")


def health(df, start):
    return drift.feature_health(df, df, "trade_date", ["f_a", "f_b"], start, slices=3)


def test_health_rows_match_pandas(features):
    rows = health(features, "2025-02-10").collect()
    pdf = features.toPandas()
    pdf["trade_date"] = pdf["trade_date"].astype(str)
    base = pdf[(pdf.trade_date >= "2025-01-11") & (pdf.trade_date < "2025-02-10")]
    assert len(rows) == 2 * 3
    for r in rows:
        if r.psi_vs_baseline == 0.0:
            assert str(r.monitoring_date) == "2025-02-09" and not r.alert_flag
            assert r.mean_value == pytest.approx(base[r.feature_name].mean(), abs=1e-6)
        else:
            day = pdf[pdf.trade_date == str(r.monitoring_date)][r.feature_name]
            want = numpy_psi(base[r.feature_name], day)
            assert r.psi_vs_baseline == pytest.approx(want, abs=1e-4)
            assert r.alert_flag == (want > 0.15)
    alerts = drift.drift_alerts(health(features, "2025-02-10"))
    assert alerts.count() == sum(r.alert_flag for r in rows)


def test_health_needs_a_full_baseline(features):
    assert health(features, "2025-01-20").count() == 0
    assert health(features, "2026-01-20").count() == 0


def test_severity_bands(spark):
    df = spark.createDataFrame([(0.01,), (0.05,), (0.15,), (0.2,), (9.0,)], "psi_vs_baseline double")
    got = [r.drift_status for r in drift.drift_report(df).collect()]
    assert got == ["baseline", "detected", "strong", "alert", "alert"]
