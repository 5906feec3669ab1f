"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake import storage
from marketlake.llm import (
    exact_dedup,
    filter_audit,
    mixing,
    packing,
    pii_semi_crf,
    quality_rules,
    records,
    secret_crf,
    sharding,
    simhash,
    site_quality,
    source_divergence,
    toxicity,
)
from marketlake.llm.shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    return public_tokenizers.path(name)


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def _listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query
def op1_secret_crf(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_crf.secrets(documents(spark, folder))
    base = F.filter("spans", lambda s: s["kind"] != "secret")
    return found.select(
        "doc_id",
        *[_counted(base, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


@query
def op4_pii_semi_crf(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_semi_crf.personal_data(documents(spark, folder))
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[_counted(base, kind).alias(f"n_{kind}") for kind in pii_semi_crf.KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(documents(spark, folder))


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(documents(spark, folder)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@query
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.members(documents(spark, folder))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), vocabulary("byte_bpe_50k.json"))


@query
def op6_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return site_quality.classify(documents(spark, folder), labels)


@query
def op7_records(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.work_dir(spark, "records")
    records.write_records(documents(spark, folder), path, vocabulary("byte_bpe_50k.json"))
    return records.read_index(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, folder)).select(
        "doc_id",
        "size",
        F.col("checksum").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.classify(documents(spark, folder), labels)


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return filter_audit.audit(documents(spark, folder), labels)


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, folder))
