"""One query for each operator, with production parameters over its whole table, and its oracle where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .bpe import round_trip_digests
from .common import documents
from .decontam import scan_documents
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .ngram_join import similarity_classes
from .quality import apply_rules
from .secret_scan import scan_secrets
from .sharding import shard_by_bytes
from .token_files import read_token_files, write_token_files
from .toxicity import examples, fit, held_out, score


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip_digests(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    listed = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    base = "filter(spans, s -> s.base)"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.expr(listed.format(base)), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(examples(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    listed = "concat_ws(',', transform(licenses, x -> concat(x.license, ':', x.matched, '/', x.words, ':', x.start, ':', x.end)))"
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.expr(listed).alias("licenses"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return read_token_files(docs, write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(documents(spark, sf_dir), k=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_token_files": op9_token_files,
    "op10_ngram_join": op10_ngram_join,
}

ORACLES: dict[str, str] = {
    "op2_sharding": oracle.SHARDS,
    "op3_quality_rules": oracle.QUALITY,
    "op4_line_dedup": oracle.LINE_DEDUP,
    "op7_decontamination": oracle.DECONTAMINATION,
}
