"""The corpus pipeline: language, exact copies, near copies, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet to the shared folder and reads it again as the next stage's documents. All
stages but the last return the columns of documents. An empty table gives an empty result;
rows that repeat are rows of their own until the copies go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import exact_dedup, jaccard_join, langid, packing, pii
from tilewright.llm.common import ensure_checkpoint_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with a score of langid.FLOOR or more.

    Texts that are null, empty or without a letter have no language and go. Where no
    document is labelled, nothing can be predicted, and all texts with a letter stay.
    """
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the document with the largest doc_id; a null text is as an empty one, a null id the smallest."""
    return exact_dedup.keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id; texts without words are one group, null ids come last."""
    return jaccard_join.keep_one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with marks in place of personal data; n_chars follows. All rows stay, a null text stays null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("personal_data", private), ("best_fit_packing", pack)]

#: Language machines, word-run sets, and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    last = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if last:  # nothing reads the stage before any more
            path(last).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(last), True)
        last = f"{folder}/{k}-{name}"
    return docs
