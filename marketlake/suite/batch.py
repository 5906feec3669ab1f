"""Batch queries, one per operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake import contracts, storage
from marketlake.functions.calendar import YEARLY
from marketlake.functions.calendar import trading_calendar as calendar_of
from marketlake.functions.columns import (
    date_key,
    is_weekend,
    pct_change,
    price_limit,
    severity_band,
)
from marketlake.operators import contract as contract_ops
from marketlake.operators import drift, gates, profile, shape, skew
from marketlake.operators.adjust import back_adjust, back_adjust_as_known
from marketlake.operators.asof import asof_join as asof
from marketlake.operators.asof import depth_bounds
from marketlake.plans import analytics, bucketed, dimensions, facts, incremental, lineage, reports, staging
from marketlake.plans.chain import Inputs
from marketlake.session import small_splits, sorted_session
from marketlake.sources import landing, messages
from marketlake.sources.views import Tables
from marketlake.streaming import routing, windows
from marketlake.streaming.parse import EVENT_SCHEMA, parse_events
from marketlake.suite.market import DRIFT_START, FIRST_LOAD, REPORT_DAY, SECOND_LOAD, Market
from marketlake.suite.registry import query

GRAIN = ["ticker_id", "trade_date"]


def ntz(column: str, alias: str | None = None):
    return F.col(column).cast("timestamp_ntz").alias(alias or column)


def fixed(value, digits: int = 4):
    """Cut a double to a number of digits for the comparison, as the SQL side does.

    Sums of doubles end in other last bits from run to run, and many prices lie at decimal
    halves. The cut is therefore a little off the half, so that those bits decide nothing;
    no operator rounds this way.
    """
    value = F.col(value) if isinstance(value, str) else value
    unit = float(10**digits)
    return F.floor(value * unit + 0.5003) / F.lit(unit)


def rounded(column: str, digits: int = 4):
    return fixed(column, digits).alias(column)


# --- contracts and shape ---------------------------------------------------------------


@query
def harmonize_versions(m: Market) -> DataFrame:
    merged = shape.harmonise(list(m.raw_versions.values()), staging.LATER_COLUMNS)
    return merged.select(
        *GRAIN, "vendor", "close", "volume", "value", "foreign_room", "_schema_version"
    )


@query
def dedup_latest(m: Market) -> DataFrame:
    latest = shape.dedup_latest(m.tables.raw_bars(), GRAIN, ["_ingested_at"])
    return latest.select(*GRAIN, "vendor", "close", "volume")


@query
def dedup_stats(m: Market) -> DataFrame:
    return shape.dedup_stats(m.tables.raw_bars(), GRAIN).withColumn(
        "removed_pct", fixed("removed_pct", 6)
    )


@query
def dq_flags(m: Market) -> DataFrame:
    turnover = F.abs(F.col("value") - F.col("close") * F.col("volume")) <= 0.005
    flagged = shape.flag_rules(
        m.staged, {**shape.bar_rules(), "_dq_value_is_turnover": turnover}
    )
    return shape.rule_failures(flagged, [c for c in flagged.columns if c.startswith("_dq_")])


@query
def contract_gate(m: Market) -> DataFrame:
    v1, v2 = m.raw_versions[1].drop("vendor"), m.raw_versions[2]
    return contract_ops.check_tables(
        [
            (v1, contracts.RAW_OHLCV_V1),
            (v1, contracts.RAW_OHLCV_V2),
            (v2, contracts.RAW_OHLCV_V1),
            (v2, contracts.RAW_OHLCV_V2),
        ]
    )


@query
def contract_rules(m: Market) -> DataFrame:
    return contract_ops.check_tables(
        [
            (m.tables.raw_bars(), contracts.RAW_OHLCV_V2),
            (m.tickers, contracts.TICKERS),
            (m.tables.actions(), contracts.CORPORATE_ACTIONS),
        ],
        rows=True,
    )


@query
def ingest_metadata(m: Market) -> DataFrame:
    parts = [
        staging.ingest(
            m.raw_versions[v].drop("vendor", "_ingested_at"),
            "batch-1",
            contracts.REGISTRY[f"raw_ohlcv_daily.v{v}"],
            v,
            f"landing/v{v}",
        )
        for v in (1, 2)
    ]
    return shape.harmonise(parts).select(
        *GRAIN,
        "volume",
        "value",
        "_schema_version",
        "_batch_id",
        "_source_path",
        F.col("_ingested_at").isNotNull().alias("stamped"),
    )


@query
def stage_daily_price(m: Market) -> DataFrame:
    staged = staging.stage_daily_price(list(m.raw_versions.values()))
    flags = [c for c in staged.columns if c.startswith("_dq_")]
    return staged.select(*facts.PRICE_COLUMNS, *flags)


@query
def stage_foreign_flow(m: Market) -> DataFrame:
    by_vendor = m.tables.ticks().groupBy(*GRAIN, "vendor").agg(
        F.sum(F.when(F.col("direction") == "O", F.col("quantity")).otherwise(0)).alias(
            "foreign_buy_vol"
        ),
        F.sum(F.when(F.col("direction") == "F", F.col("quantity")).otherwise(0)).alias(
            "foreign_sell_vol"
        ),
    )
    staged = staging.stage_foreign_flow(by_vendor.withColumn("_ingested_at", F.col("vendor")))
    return staged.select(*GRAIN, "foreign_buy_vol", "foreign_sell_vol")


# --- dimensions ---------------------------------------------------------------------------


@query
def dim_date(m: Market) -> DataFrame:
    return m.dim_date


@query
def dim_static(m: Market) -> DataFrame:
    """Members of the constant dimensions with the rows that refer to them."""

    def used(name: str, key: str, code: str, rows: DataFrame, value) -> DataFrame:
        members = dimensions.static_dimension(m.spark, name).select(
            F.lit(name).alias("dimension"), F.col(key).alias("key"), F.col(code).alias("code")
        )
        counts = rows.groupBy(value.alias("code")).agg(F.count(F.lit(1)).alias("rows"))
        return members.join(counts, "code", "left").select(
            "dimension", "key", "code", F.coalesce("rows", F.lit(0)).alias("rows")
        )

    return (
        used("dim_industry", "industry_key", "icb_code", m.tickers, F.col("icb_l1"))
        .unionByName(used("dim_exchange", "exchange_key", "exchange_code", m.tickers, F.col("exchange")))
        .unionByName(
            used("dim_session", "session_key", "session_type", m.events, F.upper("session_type"))
        )
    )


@query
def dim_ticker(m: Market) -> DataFrame:
    attributes = dimensions.ticker_attributes(m.staged, m.tickers)
    dim = dimensions.build_dim_ticker(None, attributes, FIRST_LOAD)
    return dim.select(
        "ticker_id",
        *dimensions.TICKER_ATTRIBUTES,
        ntz("valid_from_ts"),
        ntz("valid_to_ts"),
        "is_current",
    )


@query
def dim_ticker_without_reference(m: Market) -> DataFrame:
    attributes = dimensions.ticker_attributes(m.staged, None)
    return attributes.select("ticker_id", *dimensions.TICKER_ATTRIBUTES)


@query
def scd2_merge(m: Market) -> DataFrame:
    reloaded = m.tables.tickers_reloaded()
    second = dimensions.ticker_attributes(reloaded, reloaded)
    dim = dimensions.build_dim_ticker(m.dim_ticker, second, SECOND_LOAD)
    return dim.select(
        "ticker_id",
        "company_name",
        "exchange",
        "listing_status",
        ntz("valid_from_ts"),
        ntz("valid_to_ts"),
        "is_current",
    )


# --- facts ------------------------------------------------------------------------------------


@query
def adj_close(m: Market) -> DataFrame:
    adjusted = back_adjust(
        m.staged.select(*GRAIN, "close"),
        facts.price_factors(m.tables.actions()),
        "ticker_id",
        "trade_date",
        "close",
        "action_date",
        "factor",
    )
    return adjusted.select(*GRAIN, "close", rounded("adj_close"))


@query
def adj_close_asof(m: Market) -> DataFrame:
    adjusted = back_adjust_as_known(
        m.staged.select(*GRAIN, "close"),
        m.tables.actions(),
        "ticker_id",
        "trade_date",
        "close",
        "ex_date",
        "factor",
        "announced_ts",
    )
    return adjusted.select(*GRAIN, "close", rounded("adj_close"))


@query
def fact_daily_price(m: Market) -> DataFrame:
    fact = facts.build_fact_daily_price(
        m.staged_by_ticker, m.dim_ticker, m.dim_date, m.actions_by_ticker
    )
    return fact.select(
        F.col("ticker_key").isNotNull().alias("has_ticker_key"),
        "date_key",
        *facts.PRICE_COLUMNS,
        rounded("adj_close"),
    )


@query
def fact_foreign_flow(m: Market) -> DataFrame:
    return m.flow


@query
def fact_intraday(m: Market) -> DataFrame:
    dates = dimensions.build_dim_date(m.tables.read("events"), "ts")
    sessions = dimensions.static_dimension(m.spark, "dim_session")
    fact = facts.build_fact_intraday_trade(m.trades, m.dim_ticker, dates, sessions)
    return fact.select(
        "trade_id",
        "event_id",
        "ticker_id",
        "trade_date",
        ntz("event_ts"),
        ntz("created_ts_parsed"),
        "price",
        "quantity",
        "trade_value",
        "side",
        F.col("ticker_key").isNotNull().alias("has_ticker_key"),
        "date_key",
        "session_key",
    )


@query
def fact_upsert(m: Market) -> DataFrame:
    bars = m.tables.raw_bars()
    base = shape.dedup_latest(bars.filter("vendor <> 'R'"), GRAIN, ["_ingested_at"])
    merged = facts.upsert_facts(base, bars.filter("vendor = 'R'"))
    return merged.select(*GRAIN, "vendor", "close", "volume")


@query
def obt_daily(m: Market) -> DataFrame:
    return m.obt.select(
        *GRAIN,
        "close",
        rounded("adj_close"),
        rounded("pct_change_1d"),
        rounded("pct_change_5d"),
        "volume",
        rounded("volume_vs_ma20_ratio"),
        "value",
        "foreign_room",
        "foreign_net_value",
        "price_limit_hit_flag",
        *analytics.TICKER_COLUMNS,
    )


# --- features and labels ------------------------------------------------------------------------


@query
def feat_daily(m: Market) -> DataFrame:
    return m.features.select(
        *GRAIN, ntz("event_timestamp"), *[rounded(f) for f in analytics.DAILY_FEATURES]
    )


@query
def feat_unified(m: Market) -> DataFrame:
    unified = analytics.build_feat_ticker_unified(m.features, m.tick_features)
    return unified.select(
        *GRAIN,
        rounded("f_ticker_return_5d"),
        "f_stream_volume_5m_daily",
        rounded("f_stream_trade_count_30m_avg"),
    )


@query
def feature_latest(m: Market) -> DataFrame:
    versions = m.tables.raw_bars().select(
        "ticker_id",
        F.col("trade_date").cast("timestamp").alias("event_timestamp"),
        F.col("_ingested_at").cast("timestamp").alias("created_ts"),
        F.col("close").alias("f_close"),
    )
    latest = shape.dedup_latest(versions, ["ticker_id", "event_timestamp"], ["created_ts"])
    return latest.select("ticker_id", ntz("event_timestamp"), ntz("created_ts"), "f_close")


@query
def asof_join(m: Market) -> DataFrame:
    bars = m.tables.raw_bars().withColumn("bar_ts", F.col("trade_date").cast("timestamp"))
    joined = asof(
        m.tables.actions().select("action_id", "ticker_id", "announced_ts"),
        bars,
        "ticker_id",
        "announced_ts",
        "bar_ts",
        "_ingested_at",
        ["close", "vendor"],
    )
    return joined.select(
        "action_id",
        "ticker_id",
        ntz("announced_ts"),
        ntz("matched_bar_ts", "bar_ts"),
        "close",
        "vendor",
    )


@query
def asof_join_max_age(m: Market) -> DataFrame:
    bars = m.tables.raw_bars().withColumn("bar_ts", F.col("trade_date").cast("timestamp"))
    joined = asof(
        m.tables.actions().select("action_id", "ticker_id", "announced_ts"),
        bars,
        "ticker_id",
        "announced_ts",
        "bar_ts",
        "_ingested_at",
        ["close"],
        slice_seconds=86_400 * 7,
        max_age_seconds=86_400 * 2,
    )
    return joined.select("action_id", ntz("matched_bar_ts", "bar_ts"), "close")


@query
def asof_join_hot_key(m: Market) -> DataFrame:
    """The line of the same status that was shipped last before each order.

    Two statuses hold nearly all rows, so slices of equal depth spread them.
    """
    orders = m.tables.read("orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ordered")
    )
    lines = m.tables.read("lineitem").select(
        F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").alias("shipped"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"),
        "l_quantity",
    )
    day = 86_400
    bounds = m.stored(
        depth_bounds(orders, lines, "status", "ordered", "shipped", cell_seconds=day), "bounds"
    )
    joined = asof(
        orders, lines, "status", "ordered", "shipped", "line", ["line", "l_quantity"], slice_seconds=day, bounds=bounds
    )
    return joined.select("o_orderkey", "status", ntz("matched_shipped", "shipped"), "line", "l_quantity")


@query
def label_future(m: Market) -> DataFrame:
    return m.labels.select(*GRAIN, ntz("event_timestamp"), ntz("created_ts"), "label")


@query
def label_balance(m: Market) -> DataFrame:
    return gates.label_balance(m.labels, "label").withColumn(
        "positive_pct", fixed("positive_pct", 6)
    )


@query
def training_set(m: Market) -> DataFrame:
    unified = analytics.build_feat_ticker_unified(m.features, m.tick_features)
    training = analytics.build_ml_ticker_training(m.labels, unified)
    return training.select(
        *GRAIN,
        ntz("created_ts"),
        "label",
        *[rounded(c) for c in training.columns if c.startswith("f_ticker")],
        "f_stream_volume_5m_daily",
    )


# --- the chain by deliveries -----------------------------------------------------------------

FIRST_DAYS = "1998-10-15"
CORRECTED = "vendor = 'R' AND trade_date BETWEEN '1995-03-01' AND '1995-03-07'"


def _landed(m: Market) -> tuple[Tables, DataFrame, int]:
    """All vendor drops in sorted buckets of tickers, stored once for both deliveries."""
    tables = Tables(small_splits(sorted_session(m.spark)), m.tables.folder)
    # counted from the footers of the files; there are at most as many bars as prints
    buckets = bucketed.buckets_for(tables.read("lineitem").count())
    ticks = tables.ticks().repartition(buckets, "ticker_id")
    days = tables.vendor_days(ticks.sortWithinPartitions(*GRAIN, "vendor"))
    path = f"{storage.work_dir(m.spark, 'landed')}/vendor_days"
    storage.write_bucketed(days, path, "ticker_id", buckets, ["trade_date"], placed=True)
    return tables, storage.read_bucketed(tables.spark, path), buckets


def _delivered(tables: Tables, days: DataFrame, first: bool, actions: bool) -> Inputs:
    """What comes first, or what comes next: later days and corrections of a past week."""
    at_first = F.col("trade_date") <= FIRST_DAYS
    bars = tables.raw_bars(days)
    late = F.expr(CORRECTED)
    flow = tables.raw_flow(days).withColumn("_ingested_at", F.lit("2002-01-01"))
    known = F.col("ex_date") <= "1998-06-30"
    listed = tables.actions()
    return Inputs(
        [bars.filter(at_first & ~late if first else ~at_first | late)],
        flow.filter(at_first if first else ~at_first),
        listed.filter(known) if first else (listed.filter(~known) if actions else None),
        tables.tickers() if first else None,
    )


def _deliveries(m: Market, actions: bool):
    """The lake after both deliveries, and the files of its tables after the first."""
    root = storage.work_dir(m.spark, "lake")
    tables, days, parts = _landed(m)

    def files(name: str) -> DataFrame:
        table = storage.read_table(m.spark, f"{root}/{name}")
        return table.select(F.date_format("trade_date", "yyyy").alias("year"), F.input_file_name().alias("file")).distinct()

    def deliver(first: bool, effective_ts: str) -> incremental.Lake:
        inputs = _delivered(tables, days, first, actions)
        return incremental.run_increment(m.spark, root, inputs, effective_ts, period="yyyy", parts=parts)

    lake = deliver(True, FIRST_LOAD)
    before = {n: m.stored(files(n), n) for n in ("feat_ticker_daily", "ml_ticker_label")}
    deliver(False, SECOND_LOAD)
    return lake, before, files


@query
def incremental_chain(m: Market) -> DataFrame:
    """Fact, features and label after two deliveries: what one rebuild of all rows gives."""
    lake, _, _ = _deliveries(m, actions=True)
    facts_, features = lake.read("fact_daily_price"), lake.read("feat_ticker_daily")
    labels = lake.read("ml_ticker_label").select(*GRAIN, "label")
    both = facts_.join(features.select(*GRAIN, *analytics.DAILY_FEATURES), GRAIN, "left").join(labels, GRAIN, "left")
    return both.select(
        *GRAIN,
        "close",
        rounded("adj_close"),
        *[rounded(f) for f in analytics.DAILY_FEATURES],
        "label",
    )


@query
def bucketed_training(m: Market) -> DataFrame:
    """Wide table, features and label joined from tables in buckets of tickers."""
    root = storage.work_dir(m.spark, "buckets")
    # counted from the footers of the files; there are at most as many bars as prints
    buckets = bucketed.buckets_for(m.tables.read("lineitem").count())
    tables = bucketed.build(
        m.spark, root, m.staged, m.tables.raw_flow(), m.dim_ticker, m.tables.actions(), buckets=buckets
    )
    rows = bucketed.wide_training(tables)
    return rows.select(
        *GRAIN,
        rounded("adj_close"),
        rounded("pct_change_5d"),
        "foreign_net_value",
        "exchange",
        rounded("f_ticker_volatility_20d"),
        rounded("f_ticker_foreign_net_ratio_10d"),
        "label",
    )


@query
def incremental_reach(m: Market) -> DataFrame:
    """Which years of features and labels a delivery without actions writes again."""
    _, before, files = _deliveries(m, actions=False)
    told = []
    for name, old in before.items():
        found = files(name).join(old.withColumn("kept", F.lit(True)), ["year", "file"], "left")
        years = found.groupBy("year").agg(F.bool_and(F.coalesce("kept", F.lit(False))).alias("kept"))
        told.append(years.select(F.lit(name).alias("table_name"), "year", "kept"))
    return reduce(DataFrame.unionByName, told)


# --- monitoring ---------------------------------------------------------------------------------


@query
def psi(m: Market) -> DataFrame:
    """Drift of order values by month against the first year of orders."""
    orders = m.tables.read("orders").select(
        F.col("o_orderdate").cast("date").alias("day"), "o_totalprice"
    )
    month = F.trunc("day", "month").alias("month")
    values = drift.long_features(orders.select("day", month, "o_totalprice"), ["day", "month"], ["o_totalprice"])
    return drift.psi(
        values.filter("day < DATE '1996-01-01'").select("feature_name", "value"),
        values.filter("day >= DATE '1996-01-01'"),
        by="month",
    ).withColumn("psi", fixed("psi", 6))


@query
def feature_health(m: Market) -> DataFrame:
    return m.health.withColumn("mean_value", fixed("mean_value", 4))


@query
def drift_alerts(m: Market) -> DataFrame:
    return drift.drift_alerts(m.health, F.lit("2002-03-01").cast("date"))


@query
def drift_report(m: Market) -> DataFrame:
    return drift.drift_report(m.health).select(
        "monitoring_date", "feature_name", "psi_vs_baseline", "drift_status"
    )


@query
def quality_profile(m: Market) -> DataFrame:
    members = m.tickers.filter("vn30").select("ticker_id", F.lit(True).alias("_in"))
    bars = m.tables.raw_bars().join(members, "ticker_id", "left")
    return profile.bar_profile(bars, F.coalesce("_in", F.lit(False))).withColumn(
        "value", fixed("value", 4)
    )


@query
def burst_profile(m: Market) -> DataFrame:
    parsed = parse_events(m.tables.raw_events())
    return profile.event_profile(parsed, "event_id", "event_ts", "created_ts_parsed").withColumn(
        "value", fixed("value", 4)
    )


@query
def reconcile(m: Market) -> DataFrame:
    return profile.reconcile(m.tables.ticks(), m.staged, "trade_seq")


# --- gates ---------------------------------------------------------------------------------------


@query
def gate_uniqueness(m: Market) -> DataFrame:
    return gates.uniqueness(m.staged, GRAIN, "stg_daily_price").unionByName(
        gates.uniqueness(m.tables.raw_bars(), GRAIN, "raw_ohlcv_daily")
    )


@query
def gate_duplicates(m: Market) -> DataFrame:
    return gates.duplicates(m.tables.raw_bars(), GRAIN, "raw_ohlcv_daily").withColumn(
        "rate_pct", fixed("rate_pct", 6)
    )


@query
def gate_nulls(m: Market) -> DataFrame:
    return gates.nulls(
        m.tables.raw_bars(), [*GRAIN, "close", "value", "foreign_room"], "raw_ohlcv_daily"
    )


@query
def gate_referential(m: Market) -> DataFrame:
    trades = m.events.withColumnRenamed("ticker", "ticker_id")
    return gates.referential(m.fact, m.dim_ticker, "ticker_id", "fact_daily_price").unionByName(
        gates.referential(trades, m.dim_ticker, "ticker_id", "events")
    )


@query
def referential_missing_keys(m: Market) -> DataFrame:
    trades = m.events.filter("ticker IS NOT NULL").withColumnRenamed("ticker", "ticker_id")
    return gates.missing_keys(trades, m.dim_ticker, "ticker_id")


@query
def gate_calendar(m: Market) -> DataFrame:
    everything = m.tables.ticks()
    calendar = calendar_of(everything, "trade_date", 3, yearly=YEARLY).select("calendar_date", "is_trading_day")
    last_day = everything.agg(F.max("trade_date")).scalar()
    calendar = calendar.filter(F.col("calendar_date") <= last_day)
    return gates.weekend_dates(everything, "trade_date", "lineitem").unionByName(
        gates.calendar_match(everything, "trade_date", calendar, "lineitem")
    )


@query
def gate_domain(m: Market) -> DataFrame:
    return gates.domain(m.staged, list(shape.bar_rules()), "stg_daily_price")


@query
def gate_cardinality(m: Market) -> DataFrame:
    return gates.cardinality(m.staged, "ticker_id", "trade_date")


@query
def gate_price_limit(m: Market) -> DataFrame:
    changes = m.obt.select("exchange", "pct_change_1d")
    return gates.price_limit_breaks(
        changes, "pct_change_1d", price_limit("exchange"), "exchange", 0.01
    )


@query
def gate_scd2(m: Market) -> DataFrame:
    reloaded = m.tables.tickers_reloaded()
    second = dimensions.ticker_attributes(reloaded, reloaded)
    dim = dimensions.build_dim_ticker(m.dim_ticker, second, SECOND_LOAD)
    return gates.single_current(dim, "ticker_id", "dim_ticker")


@query
def gate_timestamps(m: Market) -> DataFrame:
    times = ["event_timestamp", "created_ts"]
    return gates.nulls(m.features, times, "feat_ticker_daily").unionByName(
        gates.time_order(m.labels, "event_timestamp", "created_ts", "ml_ticker_label")
    )


@query
def gate_drift(m: Market) -> DataFrame:
    return gates.drift(m.health)


# --- reports and reshaping ----------------------------------------------------------------------------


@query
def top_volume(m: Market) -> DataFrame:
    means = {"avg_volume": ("volume", 0), "avg_close": ("close", 2)}
    return reports.leaders_by_mean(m.staged, "ticker_id", means, 10, "1999-06-01")


@query
def federated_join(m: Market) -> DataFrame:
    listed = m.tickers.filter("is_active")
    day = reports.day_view(m.staged, REPORT_DAY).select(*GRAIN, "close", "volume")
    named = reports.with_attributes(day, listed, "ticker_id", ["company_name", "exchange", "icb_l1"])
    return reports.top_k(named, 20, "volume", "ticker_id")


@query
def sector_performance(m: Market) -> DataFrame:
    day = reports.day_view(m.staged, REPORT_DAY)
    change = (F.col("close") - F.col("open")) / F.col("open") * 100
    return reports.rollup_by(
        reports.with_attributes(day, m.tickers, "ticker_id", ["icb_l1"]),
        "icb_l1",
        {
            "ticker_count": F.count_distinct("ticker_id"),
            "avg_daily_return_pct": F.round(F.avg(change), 2),
            "total_volume": F.sum("volume"),
        },
    )


@query
def top_movers(m: Market) -> DataFrame:
    shares = ["pct_change_1d", "pct_change_5d", "volume_vs_ma20_ratio"]
    members = reports.day_view(m.obt, REPORT_DAY).filter("is_vn30")
    best = reports.top_k(members, 10, "pct_change_1d", "ticker")
    return best.select(
        "ticker",
        "company_name",
        "exchange",
        "icb_l1",
        "trade_date",
        "close",
        *[rounded(c) for c in shares],
        "price_limit_hit_flag",
    )


@query
def csv_report(m: Market) -> DataFrame:
    """A yearly report, exported as CSV and read back."""
    path = storage.work_dir(m.spark, "report") + "/yearly"
    bars = m.staged.withColumn("year", F.year("trade_date"))
    measures = {"bars": F.count(F.lit(1)), "volume": F.sum("volume")}
    storage.export_csv(reports.rollup_by(bars, "year", measures), path)
    return m.spark.read.schema("year int, bars long, volume long").csv(path, header=True)


@query
def dimension_rollup(m: Market) -> DataFrame:
    dims = facts.current_rows(m.dim_ticker, "exchange", "icb_l1")
    notional = fixed(F.col("close") * F.col("volume") * 100, 0).cast("long")
    return (
        m.staged.select("ticker_id", notional.alias("cents"))
        .join(dims, "ticker_id")
        .groupBy("exchange", "icb_l1")
        .agg(F.count(F.lit(1)).alias("bars"), F.sum("cents").alias("notional_cents"))
    )


@query
def share_rescale(m: Market) -> DataFrame:
    """Volumes scaled so that index members have four fifths of the total."""
    members = m.tickers.select("ticker_id", "vn30")
    bars = m.staged_by_ticker.select(*GRAIN, "close", "volume", "value").join(members, "ticker_id")
    scaled = skew.to_target_share(bars, "vn30", "volume", {True: 80, False: 20})
    value = F.when(F.col("value").isNotNull(), fixed(F.col("close") * F.col("volume"), 4))
    return scaled.select(*GRAIN, "vn30", "volume", value.alias("value"))


@query
def trading_calendar(m: Market) -> DataFrame:
    """Settlement three sessions after each order date, with the orders that settle then."""
    orders = m.tables.read("orders").select(F.col("o_orderdate").cast("date").alias("day"))
    per_day = orders.groupBy("day").agg(F.count(F.lit(1)).alias("orders"))
    calendar = calendar_of(orders, "day", 3, yearly=YEARLY)
    return (
        calendar.join(per_day, calendar.calendar_date == per_day.day, "inner")
        .select("calendar_date", "is_trading_day", "next_trading_day", "orders")
    )


@query
def next_trading_days(m: Market) -> DataFrame:
    from marketlake.functions.calendar import next_trading_days as following

    days = (
        m.tables.read("orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    return following(days, "day", 3, yearly=YEARLY).select(
        "day", "orders", F.col("day_no").cast("int").alias("day_no"), "trading_day"
    )


@query
def lineage_closure(m: Market) -> DataFrame:
    """Everything upstream of each customer and supplier: its nation and its region."""

    def node(kind: str, key: str):
        return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))

    edges = (
        m.tables.read("customer")
        .select(node("customer", "c_custkey").alias("node"), node("nation", "c_nationkey").alias("upstream"))
        .unionByName(
            m.tables.read("supplier").select(
                node("supplier", "s_suppkey").alias("node"),
                node("nation", "s_nationkey").alias("upstream"),
            )
        )
        .unionByName(
            m.tables.read("nation").select(
                node("nation", "n_nationkey").alias("node"),
                node("region", "n_regionkey").alias("upstream"),
            )
        )
    )
    return lineage.closure(edges)


@query
def scalar_suite(m: Market) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return m.tables.read("orders").select(
        "o_orderkey",
        date_key(day).alias("date_key"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.month(day).alias("month"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        is_weekend(day).alias("weekend"),
        F.upper("o_orderstatus").alias("status"),
        F.length("o_orderpriority").alias("priority_length"),
        F.concat_ws("|", F.col("o_custkey").cast("string"), day.cast("string")).alias("composite"),
        F.greatest("o_totalprice", F.lit(100000.0)).alias("at_least"),
        F.least("o_totalprice", F.lit(100000.0)).alias("at_most"),
        F.abs(F.lit(250000.0) - F.col("o_totalprice")).alias("distance"),
        fixed(F.exp(F.ln("o_totalprice")), 4).alias("exp_log"),
        F.pmod("o_custkey", F.lit(20)).alias("pmod20"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("status_or_none"),
        pct_change("o_totalprice", F.col("o_totalprice") - F.col("o_totalprice")).alias("guarded"),
        severity_band(F.pmod("o_orderkey", F.lit(30)) / F.lit(100.0)).alias("band"),
    )


# --- storage ----------------------------------------------------------------------------------------------


@query
def landing_scan(m: Market) -> DataFrame:
    # a few bars a day make tiny files, so these drops are partitioned by month
    root = storage.work_dir(m.spark, "landing-scan")
    month = F.date_format("trade_date", "yyyy-MM")
    versions = {
        v: df.drop("vendor").withColumn("trade_month", month) for v, df in m.raw_versions.items()
    }
    landing.write_versioned_landing(
        versions, root, "2002-01-01", "ohlcv_daily", day="trade_month"
    )
    latest = m.tables.bars_by_vendor().filter("vendor = 'R'").drop("_schema_version", "vendor")
    landing.write_landing(latest, root, "2002-01-02", "ohlcv_daily")
    df = landing.scan_landing(m.spark, root, "ohlcv_daily", {"schema_version": "int"})
    return df.select(
        "run_date",
        "ticker_id",
        "trade_date",
        F.col("_schema_version").cast("int").alias("_schema_version"),
        "close",
        "volume",
        "value",
        "foreign_room",
    )


@query
def ingest_layers(m: Market) -> DataFrame:
    """Versioned and flat drops of two run dates, ingested into their raw tables."""
    root = storage.work_dir(m.spark, "ingest")
    versions = {v: df.drop("vendor", "_ingested_at") for v, df in m.raw_versions.items()}
    landing.write_versioned_landing(versions, f"{root}/landing", "2002-01-01", "ohlcv_daily", day=None)
    flat = m.tables.bars_by_vendor().filter("vendor = 'R'")
    flat = flat.drop("vendor", "_ingested_at", "_schema_version")
    landing.write_landing(flat, f"{root}/landing", "2002-01-02", "ohlcv_daily")
    paths = staging.ingest_landing(m.spark, f"{root}/landing", f"{root}/raw", "b1")
    layers = [
        storage.read_table(m.spark, path).select(
            F.lit(name).alias("layer"),
            "_schema_version",
            "volume",
            (F.col("value") if name.endswith("v2") else F.lit(None).cast("double")).alias("value"),
        )
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, layers).groupBy("layer", "_schema_version").agg(
        F.count(F.lit(1)).alias("bars"),
        F.sum("volume").alias("volume"),
        F.count("value").alias("with_value"),
    )


@query
def maintained_fact(m: Market) -> DataFrame:
    """One month of a table stored by month, after a sweep that keeps its folders."""
    root = storage.work_dir(m.spark, "maintained")
    month = F.date_format("trade_date", "yyyyMM").cast("int").alias("trade_month")
    fact = m.fact.select(*GRAIN, "close", "volume", month)
    storage.write_snapshot(fact, f"{root}/fact_daily_price", "trade_month")
    storage.maintain(m.spark, root, {"fact_daily_price": ["ticker_id"]})
    return storage.read_table(m.spark, f"{root}/fact_daily_price").filter("trade_month = 199807")


@query
def partitioned_roundtrip(m: Market) -> DataFrame:
    path = storage.work_dir(m.spark, "partitioned") + "/fact"
    bars = m.tables.raw_bars()
    first = shape.dedup_latest(bars.filter("vendor <> 'R'"), GRAIN, ["_ingested_at"])
    columns = ["ticker_id", "trade_date", "volume", "vendor"]
    month = F.date_format("trade_date", "yyyyMM").cast("int").alias("trade_month")
    storage.write_snapshot(first.select(*columns, month), path, "trade_month")
    # a later run brings one year again and replaces only its months
    changes = shape.dedup_latest(bars.filter("year(trade_date) = 1998"), GRAIN, ["_ingested_at"])
    storage.overwrite_partitions(changes.select(*columns, month), path, "trade_month")
    return storage.read_table(m.spark, path).select(*columns, "trade_month")


@query
def compaction(m: Market) -> DataFrame:
    path = storage.work_dir(m.spark, "compaction") + "/bars"
    m.tables.raw_bars().repartition(64, "ticker_id").write.parquet(path)
    before, after = storage.compact(m.spark, path)
    stored = storage.read_table(m.spark, path)
    return stored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("volume").alias("volume"),
        F.count_distinct("ticker_id").alias("tickers"),
    ).withColumn("fewer_files", F.lit(after < before))


@query
def zorder_cluster(m: Market) -> DataFrame:
    path = storage.work_dir(m.spark, "zorder") + "/bars"
    m.tables.raw_bars().write.parquet(path)
    storage.compact(m.spark, path, cluster_by=["ticker_id", "trade_date"])
    return storage.read_table(m.spark, path).select(*GRAIN, "vendor", "close", "volume")


@query
def ops_run_log(m: Market) -> DataFrame:
    root = storage.work_dir(m.spark, "run-log")
    landed, rows_in = storage.counted(m.tables.raw_bars(), "in")
    staged, rows_out = storage.counted(staging.stage_daily_price([landed]), "out")
    storage.write_snapshot(staged, f"{root}/staged")
    storage.append_run_log(
        m.spark,
        f"{root}/ops_pipeline_run",
        "staging",
        "success",
        "2002-01-02T00:00:00",
        "2002-01-02T00:05:00",
        rows_in.get["rows"],
        rows_out.get["rows"],
    )
    storage.append_run_log(
        m.spark,
        f"{root}/ops_pipeline_run",
        "serving",
        "failed",
        "2002-01-02T00:06:00",
        "2002-01-02T00:06:01",
        rows_out.get["rows"],
        error_summary="target is read-only",
    )
    return storage.read_table(m.spark, f"{root}/ops_pipeline_run")


@query
def replay_log(m: Market) -> DataFrame:
    path = storage.work_dir(m.spark, "replay-log")
    parsed = parse_events(m.tables.raw_events(), [])
    landing.write_replay_log(parsed, path, "event_ts")
    stored = landing.read_replay_log(
        m.spark, path, EVENT_SCHEMA + ", event_date date, event_hour int"
    )
    return stored.groupBy("event_date", "event_hour", "event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("event_id").alias("ids"),
        F.sum(F.coalesce("quantity", F.lit(0))).alias("quantity"),
    )


@query
def kafka_envelope(m: Market) -> DataFrame:
    parsed = parse_events(m.tables.raw_events(), [])
    frame = messages.publish_frame(
        parsed, "ticker", "event_ts", ["event_id", "event_type", "created_ts", "ticker", "price"]
    )
    # a log hands back bytes with its own bookkeeping; unpack them as a consumer would
    log = frame.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit("market_events").alias("topic"),
        F.lit(0).alias("partition"),
        F.lit(0).alias("offset"),
        "timestamp",
    )
    return messages.unpack_log(log).select(
        F.col("kafka_key").alias("key"),
        ntz("kafka_ts"),
        F.get_json_object("payload_json", "$.event_id").alias("event_id"),
        F.get_json_object("payload_json", "$.price").cast("double").alias("price"),
    )


# --- skew ------------------------------------------------------------------------------------------------------


def _amplified(m: Market) -> DataFrame:
    """Bars with all tickers of one exchange under one hot key, repeated eight times more."""
    dims = facts.current_rows(m.dim_ticker, "exchange")
    bars = m.staged.select(
        *GRAIN, fixed(F.col("close") * F.col("volume") * 100, 0).cast("long").alias("cents")
    ).join(dims, "ticker_id")
    return skew.amplify(bars, F.col("exchange") == "HOSE", "ticker_id", "HOT", 1, 8)


@query
def skew_profile(m: Market) -> DataFrame:
    return _amplified(m).agg(
        F.count(F.lit(1)).alias("expanded_rows"),
        F.count_distinct("ticker_id").alias("ticker_count"),
        F.count_if(F.col("partition_key") == "HOT").alias("hot_rows"),
    )


@query
def skew_agg(m: Market) -> DataFrame:
    sums = skew.salted_agg(
        _amplified(m),
        "partition_key",
        ["ticker_id", "trade_date", "copy_id"],
        {"n": F.count(F.lit(1)), "c": F.sum("cents")},
        {"event_count": F.sum("n"), "total_cents": F.sum("c")},
    )
    return sums.orderBy(F.desc("event_count"), "partition_key").limit(20)


@query
def skew_join(m: Market) -> DataFrame:
    rows = _amplified(m)
    weights = (
        rows.select("partition_key")
        .distinct()
        .withColumn("risk_weight", F.when(F.col("partition_key") == "HOT", 3).otherwise(2))
    )
    joined = skew.salted_join(
        rows, weights, "partition_key", ["ticker_id", "trade_date", "copy_id"]
    )
    token = F.sha2(
        F.concat_ws("|", "ticker_id", F.col("trade_date").cast("string"), F.col("copy_id").cast("string")),
        256,
    )
    return (
        joined.groupBy("partition_key")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.sum(F.col("cents") * F.col("risk_weight")).alias("risk_adjusted_cents"),
            F.sum(F.length(token)).alias("token_chars"),
        )
        .orderBy(F.desc("event_count"), "partition_key")
        .limit(20)
    )


# --- event operators on batch frames --------------------------------------------------------------------------------


@query
def json_parse(m: Market) -> DataFrame:
    """Plain and wrapped payloads, broken text and unreadable event times."""
    payload = F.col("payload_json")
    kind = F.get_json_object(payload, "$.event_type")
    spoiled = (
        F.when(kind == "quote", F.concat(F.lit('{"payload":'), payload, F.lit("}")))
        .when(kind == "index_update", F.substring(payload, 1, 40))
        .when(
            F.get_json_object(payload, "$.side") == "sell",
            F.regexp_replace(payload, '"event_timestamp":"[^"]*"', '"event_timestamp":"soon"'),
        )
        .otherwise(payload)
    )
    parsed = parse_events(
        m.tables.raw_events().withColumn("payload_json", spoiled), ["source_offset"]
    )
    good = F.coalesce(F.col("reason") != "bad_json", F.lit(True))
    fields = ["event_id", "event_type", "price", "quantity", "bid_price", "ask_qty", "index_value"]
    return parsed.select(
        "source_offset",
        *[F.when(good, F.col(c)).alias(c) for c in fields],
        ntz("event_ts"),
        "reason",
    )


@query
def late_flag(m: Market) -> DataFrame:
    flagged = routing.flag_late(parse_events(m.tables.raw_events()))
    return flagged.select("source_offset", "event_id", "_late_flag")


@query
def event_routing(m: Market) -> DataFrame:
    parts = [
        part.select(F.lit(name).alias("route"), "event_id", ntz("event_ts"), "ticker")
        for name, part in routing.routes(m.events).items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def sliding_momentum(m: Market) -> DataFrame:
    rows = windows.sliding_momentum_backfill(m.trades)
    return rows.select(
        "ticker",
        ntz("window_end"),
        "f_stream_trade_count_30m",
        "first_price",
        "last_price",
    )


@query
def session_activity(m: Market) -> DataFrame:
    sessions = windows.session_activity(
        m.trades,
        "ticker",
        "event_ts",
        "2 hours",
        {"trades": F.count(F.lit(1)), "quantity": F.sum("quantity")},
    )
    return sessions.select(
        "ticker", ntz("session_start"), ntz("session_end"), "trades", "quantity"
    )


@query
def quarantine_replay(m: Market) -> DataFrame:
    from marketlake.streaming.replay import merge_quarantine, repair_windows

    trades = m.events.filter("event_type = 'trade'").select(
        "event_id", "event_ts", "ticker", "quantity", "_late_flag"
    )
    staged = trades.filter("NOT _late_flag")
    released = trades.filter("_late_flag")
    merged = merge_quarantine(staged, released)
    repaired = repair_windows(windows.tumbling_volume(staged), merged, released)
    return repaired.select(
        "ticker", ntz("window_start"), ntz("window_end"), "f_stream_volume_5m"
    )
