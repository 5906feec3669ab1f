"""Dataset lineage: direct edges and everything upstream of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake import storage

# Downstream dataset and the datasets it is built from.
EDGES = {
    "raw_ohlcv_daily": ["landing/ohlcv_daily"],
    "raw_market_events": ["market_events"],
    "stg_daily_price": ["raw_ohlcv_daily"],
    "stg_trades": ["raw_market_events"],
    "fact_daily_price": ["stg_daily_price", "dim_ticker", "dim_date"],
    "obt_ticker_daily_performance": ["fact_daily_price", "fact_foreign_flow"],
    "feat_ticker_daily": ["fact_daily_price", "fact_foreign_flow"],
    "feat_stream_intraday": ["stg_trades"],
    "feat_ticker_unified": ["feat_ticker_daily", "feat_stream_intraday"],
    "ml_ticker_training": ["feat_ticker_daily", "ml_ticker_label"],
}


def edge_table(spark: SparkSession) -> DataFrame:
    rows = [(node, upstream) for node, ups in EDGES.items() for upstream in ups]
    return spark.createDataFrame(rows, "node string, upstream string")


def closure(edges: DataFrame) -> DataFrame:
    """All (node, upstream) pairs with their smallest distance.

    Paths are joined end to end, so their length doubles every round and a graph of any
    depth takes few rounds. Every round is stored and starts from the one before. It ends
    when no pair is new; a cycle is an error.
    """
    spark = edges.sparkSession
    root = storage.work_dir(spark, "lineage")

    def stored(df: DataFrame, number: int) -> DataFrame:
        storage.write_snapshot(df, f"{root}/{number}")
        return storage.read_table(spark, f"{root}/{number}")

    paths = stored(edges.select("node", "upstream", F.lit(1).alias("depth")).distinct(), 0)
    pairs, known = paths.count(), -1
    number = 0
    while pairs != known:
        if not paths.filter("node = upstream").isEmpty():
            raise ValueError("cyclic lineage")
        ahead = paths.select(
            F.col("node").alias("upstream"), F.col("upstream").alias("_far"), F.col("depth").alias("_more")
        )
        longer = paths.join(ahead, "upstream").select(
            "node", F.col("_far").alias("upstream"), (F.col("depth") + F.col("_more")).alias("depth")
        )
        number += 1
        paths = stored(
            paths.unionByName(longer).groupBy("node", "upstream").agg(F.min("depth").alias("depth")),
            number,
        )
        pairs, known = paths.count(), pairs
    return paths
