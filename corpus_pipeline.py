"""The training-data pipeline: five stages over `documents`, each on all that the one before it kept.

Stages return the columns of `documents`; the last returns ids and decoded text. Nulls: a document
without text is clean, has no lines to repeat, is linked with nothing, holds no benchmark window and
has no ids, so it stays to the end. Where a stage keeps one of a group, a group is told by doc_id: rows
with equal doc_ids stay or go together, and rows without one stay. A very long text is handled whole in
every stage. An empty table passes as one. Ties of a group go to the smallest doc_id. Columns beyond
those of `documents` are carried along up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from quarrylog.llm.common import free_name, remove, shared_dir, swept


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more; a quarter of the labels is held out from the models, as in the query.

    All grams that occur twice in a class and all other labelled rows are used, with no cap on either."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    scorer = toxicity.fit(spark, docs, labels)
    return toxicity.reject_toxic(spark, docs, scorer)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document of which nothing but blanks is left goes, n_chars follows the text."""
    out = line_dedup.remove_repeated_lines(spark, docs)
    changed = F.col(out.columns[-1]).isNotNull()
    out = out.where(~changed | (F.trim(F.translate("text", "\t\r\n", "   ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five words, similarity 0.8)."""
    groups = jaccard_join.near_duplicates(spark, docs)
    name = free_name(docs, "gone")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded text."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("bpe", encode_bpe),
]

#: Trained scores, tokens and connected components are no SQL; tests compare each stage, and all of them, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet under the shared folder and reread; what only stages needed is deleted."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with swept():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
