"""Cleans a corpus and packs it: toxicity, near duplicates, benchmark passages, personal data, sequences.

Every stage takes and returns rows with the columns of documents, whatever further columns there are, and an empty
table gives an empty table. The stages that compare documents number the rows first (a written key), so that rows that
share a doc_id, or have none, are judged each on its own text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, jaccard, packing, pii, toxicity
from ledgerloom.llm._common import saved, table

#: The key of rows within a stage; a column of that name would be in the way and is refused.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a written key, the same whenever they are read."""
    if ROW in docs.columns:
        raise ValueError(f"documents must not have a column {ROW}")
    return saved(docs.withColumn(ROW, F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model, fitted on the labels, does not call toxic.

    Null and empty texts score 0 and stay; repeated rows share their score; without labels of both kinds all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id (null ones last).

    A group is what links of similarity 0.8 or more join, so a member may be less similar to the one kept. Rows are
    told apart by a key of their own: different texts that share a doc_id both stay, equal rows link and one stays.
    Null and wordless texts link with nothing and stay.
    """
    docs_ = _numbered(docs)
    found = jaccard.similar_documents(docs_.select(F.col(ROW).alias("doc_id"), "text")).filter("n_links > 0")
    members = saved(found.select(F.col("doc_id").alias(ROW), "group_id").join(docs_.select(ROW, "doc_id"), ROW))
    best = members.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW)))[ROW].alias(ROW))
    losers = members.select(ROW).join(best.select(ROW), ROW, "left_anti")
    return docs_.join(losers, ROW, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whatever became of its numbers and names.

    Each row is judged on its own text, with or without a doc_id; null and empty texts stay; an empty benchmark
    drops nothing.
    """
    docs_ = _numbered(docs)
    found = decontam.contaminated(docs_.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs_.join(found.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. A null text stays null."""
    found = pii.find(docs, pii.train(spark))
    found = found.withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]
#: Fitted models, MinHash and a tokenizer can't be written in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
