"""Registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import (
    conversations,
    exact_dedup,
    language_model,
    licenses,
    mixing,
    ngram_join,
    packing,
    sanitise,
    similar_lines,
    token_files,
    toxicity,
    vectors,
    whitening,
)
from tidegate.llm.common import table
from tidegate.session import new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back with a checksum of every document's ids."""
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, TOKENIZER, ("lang", "source"))
    rows = token_files.read_tokens(spark, path, columns=("doc_id", "start", "n_tokens", "ids"))
    found = token_files.with_crc32(rows)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces packed to sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, from labels outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    found = toxicity.scored(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    held_out = (toxicity.fold(F.col("doc_id")) == 0).alias("held_out")
    return found.select("doc_id", held_out, "score", "predicted", "offending")


def op5_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, and all spans with those of disclosing terms."""
    found = sanitise.find_personal(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in sanitise.KINDS],
        F.sha2(sanitise.joined(F.col("base")), 256).alias("base_sha256"),
        sanitise.joined(F.col("spans")).alias("spans"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with the line that is kept for it."""
    return similar_lines.similar_lines(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated weight, probability and draw of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component and number of links of every vector."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation after the given damage."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.of_every(rows, conversations.repaired(conversations.damaged(rows)))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, from a model of those outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    held_out = language_model.held_out(F.col("doc_id")).alias("held_out")
    return language_model.scored(documents.select("doc_id", "text", held_out))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_sanitise": op5_sanitise,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_vectors": op10_vectors,
    "op11_whitening": op11_whitening,
    "op12_repair": op12_repair,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLES = {
    "op6_exact_dedup": """
        WITH clean AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t
            FROM documents),
        hashed AS (SELECT doc_id, sha256(t) AS text_sha256 FROM clean)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM hashed WINDOW same AS (PARTITION BY text_sha256)""",
}
