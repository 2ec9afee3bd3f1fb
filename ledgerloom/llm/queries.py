"""Queries over the standard tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, decontam, embed, html_text, jaccard, license_scan, packing, pii, quantise, secret_scan, substring, token_files, toxicity
from ledgerloom.llm._common import scratch, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.train(spark, docs))
    sure = F.filter("licences", lambda x: x["confirmed"])
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    return found.select("doc_id", F.array_join(families, ",").alias("families"), F.size(sure).alias("n_confirmed"), F.size("licences").alias("n_candidates"), F.coalesce(F.array_max(F.transform(sure, lambda x: F.round(x["p"], 6))), F.lit(0.0)).alias("best_p"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(spark))
    count = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, F.sha2(pii.render(F.col("base")), 256).alias("base_sha256"), pii.render(F.col("spans")).alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_words(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.with_checksums(token_files.read_tokens(spark, path))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secret_scan.KINDS)]  # noqa: B023
    return found.select("doc_id", *count, F.sha2(secret_scan.render(F.col("base")), 256).alias("base_sha256"), secret_scan.render(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op5_pii, op2_decontaminate, op3_ngram_jaccard, op4_substring_dedup, op7_embedding_dedup, op8_toxicity, op9_packing, op6_html_text, op10_token_files, op11_vector_codes, op12_collocations, op13_secret_scan)
}
ORACLE_SQL: dict[str, str] = {}
