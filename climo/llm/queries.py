"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climo.llm import (chat, exact, lattice, lines, merkle, minhash, mixing, packing, passages, personal, quality, spelling,
                       toxicity)
from climo.llm.oracle import ORACLE  # noqa: F401 - read by __spark_entry__.py
from climo.llm.tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality features and the distribution-divergence verdict of every document (see ``quality``)."""
    return quality.score_documents(table(spark, sf_dir, "documents")).drop("text_hash", "lang")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document (see ``personal``)."""
    return personal.span_digest(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted output, of all conversations and of conversation -7 (see ``chat``)."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(extra))).drop("n_tokens")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed to weights 1, 2, 3 in turn (see ``mixing``)."""
    mixed = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages of 45 words or more that documents share, with the first document that holds each (see ``passages``)."""
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 tokens, with the CRC-32 of its ids (see ``packing``)."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), specials=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels that are not held out (see ``toxicity``)."""
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document: removed chunks, lines and the text's digest (see ``lines``)."""
    docs = table(spark, sf_dir, "documents")
    left = lines.dedup_lines(docs)
    n_lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    return left.select("doc_id", F.col("removed_chunks").cast("long").alias("removed_chunks"),
                       F.coalesce(n_lines, F.lit(0)).cast("long").alias("lines_left"),
                       F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars_left"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, Jaccard similarity of 0.85 or more (see ``minhash``)."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op10_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components and link counts of all vectors: cosine of 0.93 or more within labels (see ``lattice``)."""
    return lattice.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root of its version where it was tampered with (see ``merkle``)."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs.doc_id.cast("string")) % 7 == 0
    leaves = merkle.dataset_manifest(docs, changes={"n_chars": docs.n_chars + 1}, where=tampered)
    return leaves.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts (see ``exact``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digests = docs.withColumn("text_sha256", F.sha2(exact.normalised(F.col("text")), 256))
    return exact.exact_duplicates(digests).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, form and root (see ``spelling``)."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_personal_data": op2_personal_data,
    "op3_chat_format": op3_chat_format,
    "op4_mix_sources": op4_mix_sources,
    "op5_shared_passages": op5_shared_passages,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_vector_near_dedup": op10_vector_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
