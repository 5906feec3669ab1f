"""Quality gates. Each returns rows (gate, subject, checked, failed, severity, status)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.columns import is_weekend

FAIL, WARN = "fail", "warn"


class GateFailure(ValueError):
    """At least one blocking gate did not pass."""


def _verdict(df: DataFrame, gate: str, subject: str | Column, severity: str) -> DataFrame:
    """Turn columns ``checked`` and ``failed`` into gate rows."""
    bad = F.lit("failed" if severity == FAIL else "warning")
    return df.select(
        F.lit(gate).alias("gate"),
        (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"),
        F.col("checked").cast("long").alias("checked"),
        F.col("failed").cast("long").alias("failed"),
        F.lit(severity).alias("severity"),
        F.when(F.col("failed") > 0, bad).otherwise(F.lit("passed")).alias("status"),
    )


def uniqueness(df: DataFrame, keys: list[str], subject: str, severity: str = FAIL) -> DataFrame:
    """Groups of the declared grain that hold more than one row."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _verdict(
        groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
            F.count_if(F.col("n") > 1).alias("failed"),
        ),
        "uniqueness",
        subject,
        severity,
    )


def nulls(df: DataFrame, columns: list[str], subject: str, severity: str = FAIL) -> DataFrame:
    """NULLs in required columns, all counted in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("failed")) for c in columns]
    )
    return _verdict(
        counted.select("checked", F.inline(rows)),
        "nulls",
        F.concat(F.lit(subject + "."), F.col("column")),
        severity,
    )


def referential(
    facts: DataFrame, dimension: DataFrame, key: str, subject: str, severity: str = FAIL
) -> DataFrame:
    """Distinct fact keys, NULL included, that the dimension does not hold.

    Facts shrink to their distinct keys before the join.
    """
    keys = facts.select(key).distinct()
    known = dimension.select(key).distinct().withColumn("_known", F.lit(True))
    return _verdict(
        keys.join(known, key, "left").agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(F.col("_known").isNull()).alias("failed"),
        ),
        "referential",
        subject,
        severity,
    )


def missing_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The fact keys behind a referential failure."""
    return facts.select(key).distinct().join(dimension, key, "left_anti")


def weekend_dates(df: DataFrame, day: str, subject: str, severity: str = WARN) -> DataFrame:
    """Distinct dates that fall on a weekend."""
    return _verdict(
        df.select(day).distinct().agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(is_weekend(day)).alias("failed"),
        ),
        "weekend",
        subject,
        severity,
    )


def calendar_match(
    df: DataFrame, day: str, calendar: DataFrame, subject: str, severity: str = WARN
) -> DataFrame:
    """Two rows: facts on closed days, and trading days without facts."""
    seen = df.select(F.col(day).alias("calendar_date")).distinct().withColumn("_seen", F.lit(True))
    both = calendar.select("calendar_date", "is_trading_day").join(seen, "calendar_date", "full")
    closed = both.filter("_seen").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(~F.coalesce("is_trading_day", F.lit(False))).alias("failed"),
    )
    absent = both.filter("is_trading_day").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("_seen").isNull()).alias("failed")
    )
    return _verdict(closed, "closed_day_facts", subject, severity).unionByName(
        _verdict(absent, "missing_trading_days", subject, severity)
    )


def domain(df: DataFrame, flags: list[str], subject: str, severity: str = WARN) -> DataFrame:
    """Rows that break at least one domain flag; undecided rows do not count."""
    every = reduce(lambda a, b: a & b, [F.col(f) for f in flags])
    return _verdict(
        df.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~every).alias("failed")),
        "domain",
        subject,
        severity,
    )


def cardinality(df: DataFrame, key: str, day: str, tolerance: float = 0.1) -> DataFrame:
    """Exact distinct counts of a key and of (key, day), and whether the sketch agrees.

    Rows shrink to distinct pairs once; a sketch over distinct values equals one over rows.
    """
    pairs = df.select(key, day).distinct()
    composite = F.concat_ws("|", F.col(key), F.col(day).cast("string"))
    keys = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
    )
    exact = keys.agg(
        F.count(F.lit(1)).alias("exact_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("exact_pairs")
    )
    sketch = pairs.agg(
        F.approx_count_distinct(key).alias("keys"),
        F.approx_count_distinct(composite).alias("pairs"),
    )
    approx_keys, approx_pairs = sketch.select("keys").scalar(), sketch.select("pairs").scalar()

    def close(approx: Column, exact_name: str) -> Column:
        gap = F.abs(approx - F.col(exact_name)) / F.greatest(F.col(exact_name), F.lit(1))
        return gap <= tolerance

    return exact.select(
        "exact_keys",
        "exact_pairs",
        close(approx_keys, "exact_keys").alias("keys_agree"),
        close(approx_pairs, "exact_pairs").alias("pairs_agree"),
    )


def duplicates(df: DataFrame, keys: list[str], subject: str) -> DataFrame:
    """Share of duplicate groups in percent of all rows."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
    ).select(
        F.lit(subject).alias("subject"),
        "total",
        "duplicate_groups",
        (F.col("duplicate_groups") * 100.0 / F.greatest("total", F.lit(1))).alias("rate_pct"),
    )


def single_current(df: DataFrame, key: str, subject: str, severity: str = FAIL) -> DataFrame:
    """Keys with more than one open version."""
    keys = df.groupBy(key).agg(F.count_if("is_current").alias("n"))
    return _verdict(
        keys.agg(
            F.count(F.lit(1)).alias("checked"), F.count_if(F.col("n") > 1).alias("failed")
        ),
        "single_current",
        subject,
        severity,
    )


def time_order(
    df: DataFrame, earlier: str, later: str, subject: str, severity: str = FAIL
) -> DataFrame:
    """Rows whose knowledge time does not follow their as-of time."""
    return _verdict(
        df.agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(~F.coalesce(F.col(later) > F.col(earlier), F.lit(False))).alias("failed"),
        ),
        "time_order",
        subject,
        severity,
    )


def price_limit_breaks(
    df: DataFrame, change: str, limit: Column, group: str, tolerance: float, severity: str = WARN
) -> DataFrame:
    """Rows per group whose absolute change passes its limit and a tolerance."""
    return _verdict(
        df.groupBy(group).agg(
            F.count(change).alias("checked"),
            F.count_if(F.abs(F.col(change)) > limit + tolerance).alias("failed"),
        ),
        "price_limit",
        F.col(group),
        severity,
    )


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Label counts and the positive rate in percent."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(label) == 1).alias("positive"),
    ).select(
        "total",
        "positive",
        (F.col("total") - F.col("positive")).alias("negative"),
        (F.col("positive") * 100.0 / F.greatest("total", F.lit(1))).alias("positive_pct"),
    )


def drift(health: DataFrame) -> DataFrame:
    """Alerting health rows, as a warning."""
    return _verdict(
        health.agg(
            F.count(F.lit(1)).alias("checked"), F.count_if("alert_flag").alias("failed")
        ),
        "drift",
        "feature_health",
        WARN,
    )


def require(*results: DataFrame) -> DataFrame:
    """Run the gates once and raise when a blocking one failed; gate rows are few."""
    report = reduce(DataFrame.unionByName, results)
    broken = [r for r in report.collect() if r.status == "failed"]
    if broken:
        raise GateFailure(
            "; ".join(f"{r.gate} {r.subject}: {r.failed} of {r.checked}" for r in broken)
        )
    return report
