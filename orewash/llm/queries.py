"""The registered queries of these operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewash.llm import sql
from orewash.llm.bpe import decode, encode
from orewash.llm.common import table
from orewash.llm.conversations import reply_ordered
from orewash.llm.fingerprints import as_text, containment, distinct_shingles, fingerprint_documents
from orewash.llm.language import languages
from orewash.llm.lines import without_repeated_lines
from orewash.llm.nearcopies import near_classes
from orewash.llm.negatives import hard_negatives
from orewash.llm.neighbours import nearest
from orewash.llm.packing import pack_documents
from orewash.llm.sharding import shard_by_bytes
from orewash.llm.substrings import without_repeats
from orewash.llm.toxicity import held_out, toxicity
from orewash.llm.whitening import whiten

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
NEIGHBOUR_FACTOR = 1.3  # at 1 the search is exact; at 1.3 it still found every true neighbour of the test tables
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encoded, BYTE_RANKS).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_nearcopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("class").alias("class_id"), F.col("copies").alias("class_size"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return left.select("doc_id", "n_lines", "n_removed", "longest_run", kept)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, edited = F.col("sketch"), F.col("edited_sketch")
    return fingerprint_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        "near_edited", "near_next", containment(own, edited).alias("kept_in_edited"), distinct_shingles(own).alias("n_shingles"),
    )


def op9_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = reply_ordered(table(spark, sf_dir, "conversations"))
    return ordered.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, factor=NEIGHBOUR_FACTOR)


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages(docs, PIECES).select("doc_id", "held_out", "lang_pred", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    by_component = F.posexplode(F.arrays_zip("white", "explained")).alias("at", "of")
    return white.select("vec_id", "n", "deviation", "identity_error", by_component).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"),
        F.col("of.white").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error",
        F.col("deviation").alias("deviation_exact"),
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substrings": op2_substrings,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_nearcopies": op6_nearcopies,
    "op7_lines": op7_lines,
    "op8_fingerprints": op8_fingerprints,
    "op9_conversations": op9_conversations,
    "op10_neighbours": op10_neighbours,
    "op11_languages": op11_languages,
    "op12_whitening": op12_whitening,
    "op13_negatives": op13_negatives,
}

ORACLES: dict[str, str] = sql.ORACLES
