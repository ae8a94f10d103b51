"""The registered queries of this subpackage, each thin over its operator, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .oracles import ORACLES


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe as op

    return op.encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses as op

    return op.summary(op.license_matches(documents(spark, sf_dir)))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as op

    return op.summary(op.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op1_ans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import ans as op

    path = op.write_tokens(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return op.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding as op

    placed = op.shards(spark, documents(spark, sf_dir), k=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup as op

    return op.remove_repeats(spark, documents(spark, sf_dir), window=100, digest=True)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join as op

    return op.near_duplicates(spark, documents(spark, sf_dir), width=3, num=90, den=100)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as op

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~op.held_out(F.col("doc_id")))
    scored = op.scores(spark, docs, op.fit(spark, docs, labels))
    return scored.select("doc_id", F.coalesce(op.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= op.THRESHOLD).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup as op

    return op.exact_groups(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup as op

    return op.summary(op.remove_repeated_lines(spark, documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_ans_tokens, op2_karmarkar_karp, op3_bpe, op4_licenses, op5_decontaminate, op6_suffix_dedup, op7_jaccard_join, op8_toxicity, op9_exact_dedup, op10_line_dedup)}

__all__ = ["ORACLES", "QUERIES"]
