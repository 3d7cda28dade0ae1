"""A training corpus from raw documents: each stage works on all that the one before kept.

toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> encoding. A stage
takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``, the last
one the encoded documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vedette.llm import bpe, decontam, jaccard, lines, toxicity
from vedette.llm.common import prepared, table
from vedette.llm.queries import TOXIC_FROM, piece_model
from vedette.session import shared_folder

#: Documents go from this toxicity score on.
REJECT_FROM = TOXIC_FROM


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; held-out labels teach nothing here either."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    scored = toxicity.score_toxicity(docs, model, out="_score", offending="_offending")
    return scored.where(F.col("_score") < REJECT_FROM).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document or place has are cut out; every document stays."""
    prepared(spark)
    cleaned = lines.dedup_lines(docs, runs="_runs")
    changed = F.size("_runs") > 0
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(
        docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of 0.8 or more connect, the one with the smallest id stays."""
    prepared(spark)
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    prepared(spark)
    model = piece_model()
    coded = bpe.encode_and_decode(docs, model)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL can say the learned and the hashed stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
