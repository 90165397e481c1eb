"""A corpus pipeline: language, near-duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before it kept. NULL
columns, empty texts, repeated rows and further columns are treated as each operator's docstring
says; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnfold.llm import bpe, decontaminate, language_id, near_dedup, secrets
from tarnfold.llm.common import fresh, table, vocabulary
from tarnfold.session import ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is too unsure."""
    model = language_id.fit(language_id.trainable(docs))
    marks = (fresh(docs, "_lang"), fresh(docs, "_score"), fresh(docs, "_rejected"))
    return language_id.identify(docs, model, into=marks).filter(~F.col(marks[2])).drop(*marks)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group that shares 0.8 of its five-word shingles."""
    return near_dedup.deduplicate(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind; the stored length follows the text."""
    clean = secrets.redact(docs)
    length = F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.char_length("text").cast("long"))
    return clean.withColumn("n_chars", F.coalesce(length, F.col("n_chars").cast("long")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left."""
    return bpe.encode(docs, vocabulary("word_bpe_49k.json")).select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

# SQL cannot train a model or walk strings at random; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
