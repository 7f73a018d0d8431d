"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` are applied in order; each works on all that its predecessor kept, and each result is written as Parquet and
read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climo.llm import lines, minhash, mixing, packing, quality
from climo.llm.tables import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's reference (operator 1); the others go."""
    return quality.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks leave the texts (operator 8); n_chars follows.  A document goes when all its words
    were repeats; documents that lost nothing stay as they are."""
    removed = "removed_chunks"
    while removed in docs.columns:
        removed = f"_{removed}"
    left = lines.dedup_lines(docs)
    left = left.toDF(*docs.columns, removed)
    left = left.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest id (operator 9; five-word shingles, 0.8)."""
    return minhash.first_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights (operator 4): a document's row stands as often as it is taken."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as pieces of training sequences of at most 2048 tokens (operator 6)."""
    pieces = packing.pack_documents(docs, specials=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Tokenizing has no SQL form; tests/llm/test_pipeline.py checks every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the documents below ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
