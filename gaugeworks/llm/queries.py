"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, centroids, langid, line_dedup, mixing, packing, pii, quality, simhash, suffix, topk, trie
from .common import table

#: The vocabulary of the token queries; a parameter of the operators.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The pieces of the language query.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: The key of the surrogate query; a deployment passes its own secret to the operator.
KEY = "surrogates for the query on test tables"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality_p", "site_rate", "keep")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, KEY)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), "text", "lang")
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.with_language(rows, learnt, PIECES).drop("text")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.highest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_tokens(docs, VOCABULARY, digest=True).drop("text")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p", 6).alias("p"))


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, VOCABULARY, digest=True)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_source_mixing": op10_source_mixing,
    "op11_vector_packing": op11_vector_packing,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": line_dedup.SQL,
    "op8_exact_top_k": topk.SQL,
    "op10_source_mixing": mixing.sql(),
    "op12_centroid_clustering": centroids.sql(),
    "op13_prefix_trie": trie.SQL,
}
