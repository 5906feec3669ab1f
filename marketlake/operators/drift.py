"""Feature drift: population stability index over shared equal-width bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.functions.columns import PSI_ALERT, severity_band

# Fixed value: added to each bin share before taking logarithms.
SHARE_EPSILON = 1e-6


def long_features(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """One row per feature value; NULL and NaN are dropped."""
    doubles = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return doubles.unpivot(ids, features, "feature_name", "value").filter(
        "value IS NOT NULL AND NOT isnan(value)"
    )


def _edge(k: int | str, bins: int) -> str:
    """The ``k``-th inner edge between ``lo`` and ``hi``, as SQL."""
    return f"lo + CAST({k} AS DOUBLE) * ((hi - lo) / {bins}D)"


def psi(
    baseline: DataFrame, current: DataFrame, by: str, bins: int = 10, slices: int = 64
) -> DataFrame:
    """PSI of every (feature, ``by``) group of ``current`` against the feature's baseline.

    Inputs are long: ``feature_name``, ``value`` and, for ``current``, ``by``. Bin edges
    span baseline and group together, so they differ per group; the last bin is closed.
    Fewer than ``2 * bins`` values give 0.

    The baseline is counted under the edges of every group without pairing the two: equal
    values become one row with their number, the rows are cut into ``slices`` by content,
    the inner edges are sorted in among the values of each slice, and a running sum tells
    how many values lie below each edge. The slices add up to exact counts and keep a large
    feature from landing in one task, and so does the counting with a value that most have.
    """
    base_stats = baseline.groupBy("feature_name").agg(
        F.min("value").alias("b_lo"), F.max("value").alias("b_hi"), F.count("value").alias("b_n")
    )
    group_stats = current.groupBy("feature_name", F.col(by).alias("by")).agg(
        F.min("value").alias("c_lo"),
        F.max("value").alias("c_hi"),
        F.count("value").alias("c_n"),
    )
    lo, hi = F.least("b_lo", "c_lo"), F.greatest("b_hi", "c_hi")
    # equal bounds are widened by one half to each side
    edges = group_stats.join(base_stats, "feature_name").select(
        "feature_name",
        "by",
        "b_n",
        "c_n",
        F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
    )
    inner = range(1, bins)

    values = baseline.groupBy("feature_name", "value").agg(F.count(F.lit(1)).alias("times"))
    values = values.select(
        "feature_name",
        F.pmod(F.xxhash64("value"), F.lit(slices)).cast("int").alias("slice"),
        "value",
        "times",
    )
    marks = (
        edges.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        .select(
            "feature_name",
            "slice",
            F.expr(_edge("k", bins)).alias("value"),
            F.lit(0).cast("long").alias("times"),
            "by",
            "k",
        )
    )
    # an edge goes before equal values, which belong to the bin above it
    upward = (
        Window.partitionBy("feature_name", "slice")
        .orderBy("value", "times")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    expected = (
        values.unionByName(marks, allowMissingColumns=True)
        .withColumn("below", F.sum("times").over(upward))
        .filter("times = 0")
        .groupBy("feature_name", "by")
        .agg(*[F.expr(f"sum(below) FILTER (WHERE k = {k}) AS e{k}") for k in inner])
    )
    actual = (
        current.select("feature_name", F.col(by).alias("by"), "value")
        .join(edges, ["feature_name", "by"])
        .groupBy("feature_name", "by", "b_n", "c_n")
        .agg(*[F.expr(f"count_if(value < {_edge(k, bins)}) AS a{k}") for k in inner])
    )

    below = {
        side: f"array(0L, {', '.join(f'{side}{k}' for k in inner)}, {total})"
        for side, total in (("a", "c_n"), ("e", "b_n"))
    }
    share = {
        side: f"zip_with(slice({below[side]}, 2, {bins}), slice({below[side]}, 1, {bins}), "
        f"(upper, lower) -> (upper - lower) / greatest({total}, 1L) + {SHARE_EPSILON}D)"
        for side, total in (("a", "c_n"), ("e", "b_n"))
    }
    raw = (
        f"aggregate(zip_with({share['a']}, {share['e']}, (a, e) -> (a - e) * ln(a / e)), "
        "0D, (total, term) -> total + term)"
    )
    enough = f"b_n + c_n >= {2 * bins}"
    return actual.join(expected, ["feature_name", "by"]).select(
        "feature_name",
        F.col("by").alias(by),
        F.expr(f"CASE WHEN {enough} THEN greatest({raw}, 0D) ELSE 0D END").alias("psi"),
    )


def monitoring_dates(
    dates: DataFrame, day: str, start, baseline_size: int = 30, stride: int = 10
) -> DataFrame:
    """Role of each date: the last ``baseline_size`` before ``start``, then every ``stride``-th.

    Adds ``role`` (baseline or monitored) and ``baseline_complete``. ``dates`` has one row
    per date, so the windows below run over the calendar only.
    """
    before = F.col(day) < F.lit(start).cast("date")
    newest_first = Window.partitionBy(before).orderBy(F.col(day).desc())
    oldest_first = Window.partitionBy(before).orderBy(day)
    ranked = dates.select(
        day,
        before.alias("_before"),
        F.row_number().over(newest_first).alias("_back"),
        F.row_number().over(oldest_first).alias("_ahead"),
    )
    role = F.when(F.col("_before") & (F.col("_back") <= baseline_size), F.lit("baseline")).when(
        ~F.col("_before") & ((F.col("_ahead") - 1) % stride == 0), F.lit("monitored")
    )
    return ranked.select(day, role.alias("role")).filter("role IS NOT NULL")


def feature_health(
    features: DataFrame,
    trade_dates: DataFrame,
    day: str,
    names: list[str],
    start,
    baseline_size: int = 30,
    stride: int = 10,
    min_values: int = 10,
    slices: int = 64,
) -> DataFrame:
    """Mean and PSI of each feature on the baseline and on each monitored date.

    Groups with fewer than ``min_values`` values are left out, and nothing comes back
    unless there are ``baseline_size`` earlier dates and at least one later one.
    """
    roles = monitoring_dates(trade_dates.select(day).distinct(), day, start, baseline_size, stride)
    enough = roles.agg(
        F.count_if(F.col("role") == "baseline").alias("b"),
        F.count_if(F.col("role") == "monitored").alias("m"),
    ).select((F.col("b") >= baseline_size) & (F.col("m") > 0))
    # roles are few unless the dates are wild; Spark broadcasts them by their size
    watched = long_features(features.select(day, *names).join(roles, day), [day, "role"], names)
    watched = watched.filter(enough.scalar())
    base_all = watched.filter("role = 'baseline'")
    last_day = roles.filter("role = 'baseline'").agg(F.max(day))
    base_rows = (
        base_all.groupBy("feature_name")
        .agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
        .filter(F.col("n") >= min_values)
        .select(
            last_day.scalar().alias("monitoring_date"),
            "feature_name",
            F.round("mean", 6).alias("mean_value"),
            F.lit(0.0).alias("psi_vs_baseline"),
            F.lit(False).alias("alert_flag"),
        )
    )
    usable = base_rows.select("feature_name")
    monitored_all = watched.filter("role = 'monitored'").join(usable, "feature_name", "left_semi")
    means = (
        monitored_all.groupBy("feature_name", day)
        .agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
        .filter(F.col("n") >= min_values)
    )
    drift = psi(
        base_all.join(usable, "feature_name", "left_semi").select("feature_name", "value"),
        monitored_all.select("feature_name", day, "value"),
        by=day,
        slices=slices,
    )
    monitored = means.join(drift, ["feature_name", day]).select(
        F.col(day).alias("monitoring_date"),
        "feature_name",
        F.round("mean", 6).alias("mean_value"),
        F.round("psi", 4).alias("psi_vs_baseline"),
        (F.col("psi") > PSI_ALERT).alias("alert_flag"),
    )
    return base_rows.unionByName(monitored)


# Fixed value: text of a drift alert.
ALERT_ACTION = "Volatility regime shift suspected; evaluate model performance"


def drift_alerts(health: DataFrame, alert_date: Column | None = None) -> DataFrame:
    """One row per alerting health row; empty when there is none."""
    return health.filter("alert_flag").select(
        (F.current_date() if alert_date is None else alert_date).alias("alert_date"),
        "feature_name",
        F.col("psi_vs_baseline").alias("psi_value"),
        F.lit(ALERT_ACTION).alias("action"),
    )


def drift_report(health: DataFrame) -> DataFrame:
    """Health rows with the severity band of their PSI."""
    return health.withColumn("drift_status", severity_band("psi_vs_baseline"))
