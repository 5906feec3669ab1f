"""Wide table, features, labels, training set and monitoring tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions.columns import pct_change, positive_ratio, price_limit, relative_change
from marketlake.operators.drift import feature_health
from marketlake.operators.rolling import Series, future_label
from marketlake.plans.facts import current_rows

GRAIN = ["ticker_id", "trade_date"]
TICKER_COLUMNS = ["ticker", "company_name", "exchange", "icb_l1", "icb_l2", "is_vn30"]

# Names of the daily features, and the ones watched for drift.
DAILY_FEATURES = [
    "f_ticker_return_5d",
    "f_ticker_volatility_20d",
    "f_ticker_ma20_gap",
    "f_ticker_foreign_net_ratio_10d",
]
WATCHED_FEATURES = DAILY_FEATURES[:3]
STREAM_FEATURES = ["f_stream_volume_5m_daily", "f_stream_trade_count_30m_avg"]

# The label horizon in trading days, the required rise, the closing time.
LABEL_HORIZON = 3
LABEL_RISE = 1.01
LABEL_TIME = "15:10:00"


NET_VALUE = "foreign_net_value"


def with_net_value(prices: DataFrame, flow: DataFrame | None) -> DataFrame:
    """Prices with the day's net foreign value; NULL without a flow table.

    Prices that already carry the column are taken as they are.
    """
    if NET_VALUE in prices.columns:
        return prices
    if flow is None:
        return prices.withColumn(NET_VALUE, F.lit(None).cast("long"))
    return prices.join(flow.select(*GRAIN, NET_VALUE), GRAIN, "left")


def _wide_windows(series: Series) -> dict[str, Column]:
    return {
        "prev_close": series.lag("close"),
        "close_5d_ago": series.lag("close", 5),
        "_volume_ma20": series.mean("volume", 20),
    }


def _feature_windows(series: Series) -> dict[str, Column]:
    return {
        "prev_close": series.lag("close"),
        "close_5d_ago": series.lag("close", 5),
        "_ma20": series.mean("close", 20),
        "_net10": series.total(F.coalesce(NET_VALUE, F.lit(0)), 10),
        "_value10": series.total(F.coalesce("value", F.lit(0.0)), 10),
    }


def _feature_values(series: Series, known_flow: bool) -> list[Column]:
    """The features, from their windows and ``_return``."""
    ratio = positive_ratio(F.col("_net10"), F.col("_value10"))
    return [
        relative_change("close", "close_5d_ago").alias("f_ticker_return_5d"),
        series.deviation("_return", 20).alias("f_ticker_volatility_20d"),
        relative_change("close", "_ma20").alias("f_ticker_ma20_gap"),
        (ratio if known_flow else F.lit(None)).cast("double").alias("f_ticker_foreign_net_ratio_10d"),
    ]


def _wide_rows(windowed: DataFrame, dim_ticker: DataFrame | None, keep: list[str] | None = None) -> DataFrame:
    attributes = []
    if dim_ticker is not None:
        windowed = windowed.join(current_rows(dim_ticker, *TICKER_COLUMNS), "ticker_id", "left")
        attributes = TICKER_COLUMNS
    limit = price_limit("exchange") if attributes else price_limit(F.lit(None).cast("string"))
    change = pct_change("close", "prev_close")
    return windowed.select(
        "ticker_id",
        "trade_date",
        "close",
        "adj_close",
        change.alias("pct_change_1d"),
        pct_change("close", "close_5d_ago").alias("pct_change_5d"),
        "volume",
        F.try_divide("volume", "_volume_ma20").alias("volume_vs_ma20_ratio"),
        "value",
        "foreign_room",
        "foreign_net_value",
        (F.abs(change) >= limit).alias("price_limit_hit_flag"),
        *attributes,
        *(keep or []),
    )


def build_obt(
    fact: DataFrame, dim_ticker: DataFrame | None, flow: DataFrame | None
) -> DataFrame:
    """Denormalised daily performance per ticker, from raw closes."""
    series = Series("ticker_id", "trade_date")
    return _wide_rows(with_net_value(fact, flow).withColumns(_wide_windows(series)), dim_ticker)


def build_feat_ticker_daily(fact: DataFrame, flow: DataFrame | None) -> DataFrame:
    """Daily features over trading-day windows, from raw closes."""
    series = Series("ticker_id", "trade_date")
    known = flow is not None or NET_VALUE in fact.columns
    windowed = (
        with_net_value(fact, flow)
        .withColumns(_feature_windows(series))
        .withColumn("_return", relative_change("close", "prev_close"))
    )
    return windowed.select(
        *GRAIN,
        F.col("trade_date").cast("timestamp").alias("event_timestamp"),
        F.current_timestamp().alias("created_ts"),
        *_feature_values(series, known),
    )


class DailyNumbers:
    """Wide table, features, labels and training set from one frame.

    The windows of all of them run over the rows of a ticker in the order of dates, so they
    share one sort; the frame is stored once and each table takes its columns from it, with
    the columns ``keep`` beside them.
    """

    def __init__(self, rows: DataFrame, keep: list[str]):
        self.rows, self.keep = rows, keep

    @staticmethod
    def compute(fact: DataFrame, known_flow: bool) -> DataFrame:
        """The fact, which has its net foreign value, with all that the tables need of windows."""
        series = Series("ticker_id", "trade_date")
        future = series.lead("adj_close", LABEL_HORIZON)
        windowed = (
            fact.withColumns(
                {
                    **_wide_windows(series),
                    **_feature_windows(series),
                    "_future": future,
                    "label_available_date": series.lead("trade_date", LABEL_HORIZON),
                }
            )
            .withColumn("_return", relative_change("close", "prev_close"))
        )
        return windowed.select(
            *fact.columns,
            "prev_close",
            "close_5d_ago",
            "_volume_ma20",
            *_feature_values(series, known_flow),
            F.col("_future").isNotNull().alias("_labelled"),
            (F.col("_future") > F.col("adj_close") * LABEL_RISE).cast("int").alias("label"),
            _known_at().alias("_known_at"),
        )

    def wide(self, dim_ticker: DataFrame) -> DataFrame:
        return _wide_rows(self.rows, dim_ticker, self.keep)

    def features(self) -> DataFrame:
        day = F.col("trade_date").cast("timestamp")
        return self.rows.select(
            *GRAIN, day.alias("event_timestamp"), F.current_timestamp().alias("created_ts"), *DAILY_FEATURES, *self.keep
        )

    def labels(self) -> DataFrame:
        return self.rows.filter("_labelled").select(*_label_columns(F.col("_known_at")), *self.keep)

    def training(self, stream: DataFrame | None) -> DataFrame:
        rows = with_stream_features(self.rows.filter("_labelled"), stream)
        return rows.select(*_label_columns(F.col("_known_at")), *DAILY_FEATURES, *STREAM_FEATURES, *self.keep)


def with_stream_features(rows: DataFrame, stream: DataFrame | None) -> DataFrame:
    """Rows with the day's stream features; typed NULLs without a stream."""
    if stream is None:
        return rows.withColumns(
            {
                "f_stream_volume_5m_daily": F.lit(None).cast("long"),
                "f_stream_trade_count_30m_avg": F.lit(None).cast("double"),
            }
        )
    per_day = stream.groupBy(
        "ticker_id", F.to_date("event_timestamp").alias("trade_date")
    ).agg(
        F.sum("f_stream_volume_5m").alias("f_stream_volume_5m_daily"),
        F.avg("f_stream_trade_count_30m").alias("f_stream_trade_count_30m_avg"),
    )
    return rows.join(per_day, GRAIN, "left")


def build_feat_ticker_unified(daily: DataFrame, stream: DataFrame | None) -> DataFrame:
    """Daily features with the day's stream features; typed NULLs without a stream."""
    return with_stream_features(daily.select(*GRAIN, "event_timestamp", "created_ts", *DAILY_FEATURES), stream)


def _known_at() -> Column:
    day = F.col("label_available_date")
    return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), *[F.lit(int(n)) for n in LABEL_TIME.split(":")])


def _label_columns(known_at: Column) -> list[str | Column]:
    return [
        *GRAIN,
        F.col("trade_date").cast("timestamp").alias("event_timestamp"),
        known_at.alias("created_ts"),
        "label",
    ]


def build_ml_ticker_label(fact: DataFrame) -> DataFrame:
    """Whether the adjusted close rises in the next trading days, and when that is known."""
    labelled = future_label(
        fact.select(*GRAIN, "adj_close"),
        "ticker_id",
        "trade_date",
        "adj_close",
        LABEL_HORIZON,
        LABEL_RISE,
    )
    return labelled.select(*_label_columns(_known_at()))


def build_ml_ticker_training(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Labels with the features of their day; the label's times are kept."""
    names = [c for c in features.columns if c.startswith("f_")]
    return labels.join(features.select(*GRAIN, *names), GRAIN).select(
        *GRAIN, "event_timestamp", "created_ts", "label", *names
    )


def build_feature_health(
    features: DataFrame, fact: DataFrame, drift_start, slices: int = 64
) -> DataFrame:
    """Drift of the watched features over the trading dates of the fact."""
    names = [c for c in WATCHED_FEATURES if c in features.columns]
    return feature_health(
        features, fact.select("trade_date"), "trade_date", names, drift_start, slices=slices
    )
