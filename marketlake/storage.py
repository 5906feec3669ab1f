"""Table snapshots on a shared file system: write, read, compact, cluster, log."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUN_LOG_SCHEMA = (
    "run_id string, pipeline string, start_time string, end_time string, status string, "
    "input_rows bigint, output_rows bigint, error_summary string"
)


# --- locations -----------------------------------------------------------------


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables and stream checkpoints.

    It sits in the shared folder named by ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder of this machine, removed at its end.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        folder = tempfile.mkdtemp(prefix=f"spark-{label}-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    fs, hadoop_path = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(hadoop_path) or []))


def swap_in(spark: SparkSession, staged: str, target: str) -> None:
    """Replace ``target`` with a completely written ``staged`` folder.

    The old snapshot is moved aside first, so a failure between the two renames
    leaves both copies on disk and nothing is lost.
    """
    fs, staged_path = _fs(spark, staged)
    _, target_path = _fs(spark, target)
    _, old_path = _fs(spark, f"{target}.old-{uuid.uuid4().hex}")
    fs.mkdirs(target_path.getParent())
    had_old = fs.exists(target_path)
    if had_old and not fs.rename(target_path, old_path):
        raise OSError(f"cannot move aside {target}")
    if not fs.rename(staged_path, target_path):
        if had_old:
            fs.rename(old_path, target_path)
        raise OSError(f"cannot move {staged} to {target}")
    if had_old:
        fs.delete(old_path, True)


# --- reads and writes ------------------------------------------------------------


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.format(fmt).load(path)


def read_table_if_present(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    return spark.read.format(fmt).load(path) if path_exists(spark, path) else None


def write_snapshot(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    fmt: str = "parquet",
    writers: int | None = None,
    sort_by: list[str] | None = None,
) -> None:
    """Replace a whole table, schema included; safe when ``df`` reads the same path.

    With ``sort_by`` the rows of a file are in that order, so that its statistics skip.

    Rows are rebalanced on the partition column, so a date holds few files and a
    date with very many rows is split over several tasks. Tasks are sized by bytes; for a
    small table with very many partitions ``writers`` sets their number instead.
    """
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    if partition_by:
        placed = (
            df.repartition(writers, partition_by) if writers else df.hint("rebalance", partition_by)
        )
        if sort_by:
            placed = placed.sortWithinPartitions(partition_by, *sort_by)
        placed.write.format(fmt).partitionBy(partition_by).save(staged)
    else:
        ordered = df.sortWithinPartitions(*sort_by) if sort_by else df
        ordered.write.format(fmt).save(staged)
    swap_in(spark, staged, path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: str, fmt: str = "parquet") -> None:
    """Replace only the partitions that occur in ``df``."""
    (
        df.hint("rebalance", partition_by)
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_by)
        .save(path)
    )


def _layout_file(path: str) -> str:
    return f"{path}.layout"


def bucketed_files(
    df: DataFrame,
    path: str,
    key: str,
    buckets: int,
    sort_by: list[str] | None = None,
    partition_by: str | None = None,
) -> None:
    """Write a new folder of files by bucket. Rows that lie by the hash of ``key`` in ``buckets``
    parts make one file a bucket, or one a bucket and folder of ``partition_by``; others more.
    Without ``sort_by`` they stay in the order in which they come.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = (df.write.partitionBy(partition_by) if partition_by else df.write).bucketBy(buckets, key)
    if sort_by is not None:
        writer = writer.sortBy(key, *sort_by)
    writer.option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table: its files stay


def declare_bucketed(
    spark: SparkSession,
    path: str,
    schema: StructType,
    key: str,
    buckets: int,
    sort_by: list[str] | None = None,
    partition_by: str | None = None,
) -> str:
    """Make files of ``bucketed_files`` known to the session's catalogue under a new name.

    Folders are found by listing them if the session does not manage them in its catalogue, as
    ``bucketed_session`` does not.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    order = "" if sort_by is None else f"SORTED BY ({', '.join(f'`{c}`' for c in [key, *sort_by])}) "
    folders = f"PARTITIONED BY (`{partition_by}`) " if partition_by else ""
    spark.sql(
        f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet OPTIONS (path '{path}') {folders}"
        f"CLUSTERED BY (`{key}`) {order}INTO {buckets} BUCKETS"
    )
    return name


def write_bucketed(
    df: DataFrame, path: str, key: str, buckets: int, sort_by: list[str], placed: bool = False
) -> None:
    """Replace a table by one in ``buckets`` files; the rows of a key lie in one file, sorted.

    Rows that are ``placed`` lie by the hash of the key in as many parts already. Parquet
    itself does not tell of buckets, so their number and columns are kept beside the
    table, and ``read_bucketed`` declares them to the session's catalogue.
    """
    spark = df.sparkSession
    rows = df if placed else df.repartition(buckets, key).sortWithinPartitions(key, *sort_by)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    bucketed_files(rows, staged, key, buckets, sort_by)
    swap_in(spark, staged, path)
    layout = spark.createDataFrame(
        [(df.schema.json(), key, buckets, sort_by)], "schema string, key string, buckets int, sort_by array<string>"
    )
    layout.coalesce(1).write.mode("overwrite").json(_layout_file(path))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_bucketed``, known by the session to be partitioned by its key."""
    layout = spark.read.schema("schema string, key string, buckets int, sort_by array<string>").json(_layout_file(path))
    (row,) = layout.collect()
    schema = StructType.fromJson(json.loads(row["schema"]))
    return spark.table(declare_bucketed(spark, path, schema, row["key"], row["buckets"], row["sort_by"]))


def export_csv(df: DataFrame, path: str) -> None:
    """Write a report as one CSV file with a header; meant for aggregated rows only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# --- run log -----------------------------------------------------------------------


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass by, without a second job."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def append_run_log(
    spark: SparkSession,
    path: str,
    pipeline: str,
    status: str,
    started: str,
    ended: str,
    input_rows: int | None = None,
    output_rows: int | None = None,
    error_summary: str | None = None,
) -> None:
    """Append one row about a finished run."""
    run_id = f"{pipeline}_{started}"
    row = (run_id, pipeline, started, ended, status, input_rows, output_rows, error_summary)
    spark.createDataFrame([row], RUN_LOG_SCHEMA).write.mode("append").parquet(path)


# --- upkeep --------------------------------------------------------------------------


def file_stats(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of data files under a table and their total bytes."""
    fs, hadoop_path = _fs(spark, path)
    listing = fs.listFiles(hadoop_path, True)
    files, size = 0, 0
    while listing.hasNext():
        status = listing.next()
        if not status.getPath().getName().startswith(("_", ".")):
            files += 1
            size += status.getLen()
    return files, size


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns that a stored table keeps as folders, outermost first."""
    fs, current = _fs(spark, path)
    found: list[str] = []
    while True:
        folders = [
            s.getPath()
            for s in fs.listStatus(current)
            if s.isDirectory() and "=" in s.getPath().getName()
        ]
        if not folders:
            return found
        found.append(folders[0].getName().split("=", 1)[0])
        current = folders[0]


# stored MB that one task sorts; in memory they were measured to be eight times as many
SORT_MB = 32


def compact(
    spark: SparkSession,
    path: str,
    target_mb: int = 256,
    cluster_by: list[str] | None = None,
    sort_mb: int = SORT_MB,
) -> tuple[int, int] | None:
    """Rewrite a table in files of about ``target_mb``; return file counts before and after.

    Partition folders stay as they are. With ``cluster_by`` rows are range-partitioned and
    sorted on these columns, so that file statistics skip on the first of them and, within
    it, on the next. A task sorts about ``sort_mb`` of stored data, which is many times that in
    memory, so clustered files are smaller. A missing table is left out.
    """
    if not path_exists(spark, path):
        return None
    files_before, size = file_stats(spark, path)
    task_mb = min(target_mb, sort_mb) if cluster_by else target_mb
    parts = max(1, -(-size // (task_mb * 1024 * 1024)))
    df = spark.read.parquet(path)
    folders = partition_columns(spark, path)
    keys = folders + [c for c in cluster_by or [] if c not in folders]
    if cluster_by:
        df = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    elif folders:
        df = df.hint("rebalance", *folders)
    else:
        df = df.repartition(parts)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*folders) if folders else df.write
    writer.parquet(staged)
    swap_in(spark, staged, path)
    return files_before, file_stats(spark, path)[0]


# The tables kept compact and the columns they are clustered on.
UPKEEP_TABLES = {
    "fact_daily_price": ["ticker_id"],
    "obt_ticker_daily_performance": ["ticker_id", "trade_date"],
    "feat_ticker_daily": ["ticker_id"],
    "feat_ticker_unified": ["ticker_id"],
    "ml_ticker_training": ["ticker_id"],
    "dim_ticker": ["ticker_id"],
}


def maintain(
    spark: SparkSession, root: str, tables: dict[str, list[str]] | None = None, target_mb: int = 256
) -> dict[str, tuple[int, int] | None]:
    """Compact and cluster each table under ``root``, its partition folders kept; absent
    ones give None.
    """
    return {
        name: compact(spark, f"{root}/{name}", target_mb, columns)
        for name, columns in (tables or UPKEEP_TABLES).items()
    }
