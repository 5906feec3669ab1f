"""Session settings shared by batch and streaming work."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Every value here is a Spark default made explicit or a setting that lets the
# optimiser decide at run time; nothing is tuned to one machine.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "50MB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # sessions of a busy key are merged within each map task before the shuffle
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "marketlake", overrides: dict[str, str] | None = None) -> SparkSession:
    """Return a session with the shared settings; the master comes from the launcher."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SESSION_DEFAULTS, **(overrides or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Make zone-less event times and UTC instants the same thing in this session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def small_splits(spark: SparkSession, mb: int = 16) -> SparkSession:
    """Read files and shuffles in parts of at most about ``mb``.

    A task that aggregates nearly distinct keys holds about as many groups as it reads rows,
    some twenty times the bytes of its part, so the part bounds its memory. Smaller settings
    are left as they are.
    """
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if as_bytes(spark.conf.get(name)) > mb << 20:
            spark.conf.set(name, f"{mb}m")
    return spark


def bucketed_session(spark: SparkSession) -> SparkSession:
    """Return a sibling session in which tables bucketed by a part of the join keys are joined
    as they lie.

    Spark otherwise shuffles both sides of a join on (ticker, date) that are partitioned by
    ticker alone. It is right to leave them where a key's rows are bounded, as bars are.
    """
    sibling = pin_utc(spark.newSession())
    sibling.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # folders of bucketed tables are listed, and not entered into the catalogue one by one
    sibling.conf.set("spark.sql.hive.manageFilesourcePartitions", "false")
    return sibling


def sorted_session(spark: SparkSession, writers: int = 32) -> SparkSession:
    """Return a ``bucketed_session`` that keeps the order of rows: a scan of one file a bucket is
    known to be sorted as the bucket is, sorted rows are grouped as they come, and a task writes
    up to ``writers`` files at a time without another sort.
    """
    sibling = bucketed_session(spark)
    sibling.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    sibling.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    sibling.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(writers))
    return sibling


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """Return a sibling session whose streaming state is sized to the cluster.

    The number of state partitions is fixed when a query first starts, so it follows
    the cores at hand and not a batch setting. State lives in RocksDB, off the heap.
    """
    sibling = pin_utc(spark.newSession())
    wanted = state_partitions or spark.sparkContext.defaultParallelism
    sibling.conf.set("spark.sql.shuffle.partitions", str(wanted))
    sibling.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    sibling.conf.set(
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"
    )
    return sibling
