"""Market-data views over the TPC-H-like tables: ticks, bars, tickers, actions, events.

Every view reads its whole table. Money is summed in whole cents, so results do not
depend on the order in which tasks add numbers up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.columns import action_factor
from marketlake.operators.shape import tag_version
from marketlake.plans.dimensions import static_dimension

SCHEMA_CUTOVER = "1998-07-01"
TOPIC = "market_events"
REPLAY_DELAY_SECONDS = 120
FLOW_COLUMNS = ["foreign_buy_vol", "foreign_sell_vol", "foreign_buy_value", "foreign_sell_value"]


def _bar_columns() -> list[Column]:
    """A bar from the prints of its group."""
    return [
        F.min_by("price", "trade_seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "trade_seq").alias("close"),
        F.sum("quantity").alias("volume"),
        (F.sum("value_cents") / F.lit(100.0)).alias("value"),
        F.sum("room").cast("double").alias("foreign_room"),
    ]


def _flow_columns() -> list[Column]:
    """Foreign buys (direction O) and sells (F) from the prints of a group."""
    buy, sell = F.col("direction") == "O", F.col("direction") == "F"

    def total(side, column):
        return F.sum(F.when(side, F.col(column)).otherwise(0))

    totals = [total(buy, "quantity"), total(sell, "quantity"), total(buy, "value_cents"), total(sell, "value_cents")]
    return [t.alias(name) for t, name in zip(totals, FLOW_COLUMNS)]


class Tables:
    """The tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    # --- prices ---------------------------------------------------------------------

    def ticks(self) -> DataFrame:
        """Every line item as a trade print, weekend dates included.

        ``trade_seq`` orders prints within a day.
        """
        return self.read("lineitem").select(
            F.col("l_suppkey").cast("string").alias("ticker_id"),
            F.col("l_shipdate").cast("date").alias("trade_date"),
            (
                (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64
                + F.col("l_quantity").cast("long")
            ).alias("trade_seq"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").cast("long").alias("quantity"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("value_cents"),
            F.round(F.col("l_tax") * 100).cast("long").alias("room"),
            F.col("l_linestatus").alias("direction"),
            F.col("l_returnflag").alias("vendor"),
        )

    def vendor_days(self, ticks: DataFrame | None = None) -> DataFrame:
        """Bar, foreign buys (direction O) and sells (F) per ticker, date and vendor drop: one
        (ticker, date) may occur three times.
        """
        return (self.ticks() if ticks is None else ticks).groupBy("ticker_id", "trade_date", "vendor").agg(
            *_bar_columns(), *_flow_columns()
        )

    def bars_by_vendor(self, days: DataFrame | None = None) -> DataFrame:
        """The bars of ``vendor_days``, from the prints unless they are given."""
        if days is None:
            bars = self.ticks().groupBy("ticker_id", "trade_date", "vendor").agg(*_bar_columns())
        else:
            bars = days.drop(*FLOW_COLUMNS)
        hour = F.when(F.col("vendor") == "A", 10).when(F.col("vendor") == "N", 11).otherwise(12)
        return tag_version(bars, "trade_date", SCHEMA_CUTOVER).withColumn(
            "_ingested_at",
            F.concat(F.lit("2002-01-01 "), hour.cast("string"), F.lit(":00:00")),
        )

    def raw_bars(self, days: DataFrame | None = None) -> DataFrame:
        """Vendor bars as landed: version 1 has neither value nor foreign room."""
        late = F.col("_schema_version") == 2
        return self.bars_by_vendor(days).withColumns(
            {c: F.when(late, F.col(c)) for c in ("value", "foreign_room")}
        )

    def raw_flow(self, days: DataFrame | None = None) -> DataFrame:
        """Foreign buys and sells per ticker and date, values in cents."""
        if days is None:
            return self.ticks().groupBy("ticker_id", "trade_date").agg(*_flow_columns())
        return days.groupBy("ticker_id", "trade_date").agg(*[F.sum(c).alias(c) for c in FLOW_COLUMNS])

    # --- reference data -----------------------------------------------------------------

    def tickers(self) -> DataFrame:
        """Suppliers as listed companies with exchange and industry."""
        region = F.col("r_regionkey") % 3
        industry = static_dimension(self.spark, "dim_industry")
        return (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(
                F.broadcast(industry),
                F.col("n_nationkey") % 10 + 1 == F.col("industry_key"),
            )
            .select(
                F.col("s_suppkey").cast("string").alias("ticker_id"),
                F.concat(F.lit("TK"), F.col("s_suppkey").cast("string")).alias("ticker"),
                F.col("s_name").alias("company_name"),
                F.when(region == 0, "HOSE").when(region == 1, "HNX").otherwise("UPCOM").alias(
                    "exchange"
                ),
                F.col("icb_code").alias("icb_l1"),
                F.col("n_name").alias("icb_l2"),
                (F.col("s_acctbal") > 0).alias("is_active"),
                (F.col("s_suppkey") < 30).alias("vn30"),
            )
        )

    def tickers_reloaded(self) -> DataFrame:
        """The next delivery: low-balance companies renamed, small ones left out, new ones in."""
        base = self.tickers().join(
            self.read("supplier").select(
                F.col("s_suppkey").cast("string").alias("ticker_id"), "s_acctbal"
            ),
            "ticker_id",
        )
        kept = base.filter("s_acctbal < 9000").withColumn(
            "company_name",
            F.when(F.col("s_acctbal") < 1000, F.concat("company_name", F.lit(" Holdings")))
            .otherwise(F.col("company_name")),
        )
        fresh = base.filter("s_acctbal >= 9000").withColumn(
            "ticker_id", F.concat(F.lit("N"), F.col("ticker_id"))
        )
        return kept.unionByName(fresh).drop("s_acctbal")

    def actions(self) -> DataFrame:
        """Orders as corporate actions of the ticker behind each group of 15 customers."""
        kind = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "split")
            .when(F.col("o_orderpriority") == "2-HIGH", "stock_dividend")
            .otherwise("cash_dividend")
        )
        cents = F.round(F.col("o_totalprice") * 100).cast("long") % 100
        ex_date = F.col("o_orderdate").cast("date")
        return (
            self.read("orders")
            .select(
                F.col("o_orderkey").cast("string").alias("action_id"),
                F.floor(F.col("o_custkey") / 15).cast("string").alias("ticker_id"),
                kind.alias("action_type"),
                ex_date.alias("ex_date"),
                (F.when(kind == "split", F.lit(1.0)).otherwise(F.lit(0.0)) + (cents + 1) / F.lit(1000.0))
                .alias("ratio"),
                F.date_sub(ex_date, 10).cast("timestamp").alias("announced_ts"),
            )
            .withColumn("factor", action_factor("action_type", "ratio"))
        )

    # --- events -------------------------------------------------------------------------

    def event_schema(self):
        return self.read("events").schema

    def raw_events(self, rows: DataFrame | None = None) -> DataFrame:
        """Events as raw messages; purchases are delivered twice, two minutes apart.

        ``rows`` may be a stream over the events table; the view is the same for both.
        """
        rows = self.read("events") if rows is None else rows
        kind = (
            F.when(F.col("event_type").isin("purchase", "click"), "trade")
            .when(F.col("event_type").isin("view", "signup"), "quote")
            .otherwise("index_update")
        )
        delay = F.get_json_object("props", "$.k").cast("long")
        ts = F.col("ts").cast("timestamp")
        delays = F.when(
            F.col("event_type") == "purchase", F.array(F.lit(0), F.lit(REPLAY_DELAY_SECONDS))
        ).otherwise(F.array(F.lit(0)))
        trade, quote, index = (kind == k for k in ("trade", "quote", "index_update"))
        hour = F.hour(ts)
        session = (
            F.when(hour < 9, "ato").when(hour < 14, "continuous").when(hour < 15, "atc")
            .otherwise("put_through")
        )

        def stamp(column):
            return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

        rows = rows.withColumn("_extra", F.explode(delays))
        arrival = F.timestamp_micros(
            F.unix_micros(ts) + (delay + F.col("_extra")) * 1_000_000
        )
        price = F.col("value")
        payload = F.struct(
            F.col("event_id").cast("string").alias("event_id"),
            kind.alias("event_type"),
            stamp(ts).alias("event_timestamp"),
            stamp(arrival).alias("created_ts"),
            session.alias("session_type"),
            F.when(~index, F.col("user_id").cast("string")).alias("ticker"),
            F.lit("HOSE").alias("exchange"),
            F.when(trade, price).alias("price"),
            F.when(trade, delay + 1).alias("quantity"),
            F.when(F.col("event_type") == "purchase", "buy")
            .when(F.col("event_type") == "click", "sell")
            .alias("side"),
            F.when(trade, F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("trade_id"),
            F.when(quote, price).alias("bid_price"),
            F.when(quote, delay + 1).alias("bid_qty"),
            F.when(quote, price + 1).alias("ask_price"),
            F.when(quote, delay + 2).alias("ask_qty"),
            F.when(index, "MAIN").alias("index_name"),
            F.when(index, price).alias("index_value"),
            F.when(index, F.lit(0.0)).alias("index_change_pct"),
        )
        return rows.select(
            F.to_json(payload).alias("payload_json"),
            (F.col("event_id") * 2 + (F.col("_extra") > 0).cast("long")).alias("source_offset"),
            (F.col("event_id") % 4).alias("source_partition"),
            F.lit(TOPIC).alias("source_topic"),
            arrival.alias("kafka_ts"),
            F.coalesce(F.when(~index, F.col("user_id").cast("string")), F.lit("INDEX")).alias(
                "kafka_key"
            ),
            F.current_timestamp().alias("_ingested_at"),
        )
