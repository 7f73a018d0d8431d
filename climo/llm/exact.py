"""Exact deduplication by progressive refinement: length, then a hash of the start, then a hash of the whole text.

Texts are equal when they are identical after A-Z are put in lower case; null counts as empty.

* Texts are grouped by their length in bytes, which case doesn't change.
* Only texts of a length that occurs twice have their first ``PREFIX`` characters hashed, and are grouped by (length, hash).
* Only texts of a group that still has two members are read in full and grouped by SHA-256.

What survives a step is handed to the next as a bitmap of the surviving codes: at most ``BITS`` / 64 rows of one
long each, so its broadcast is bounded at every size and no text is ever shuffled.  A code that falls on another's bit costs
one more hash and changes no result.  Groups are met by sums before the shuffle, however many copies they hold.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climo.llm.tables import written

#: Characters of a text that the second step reads.
PREFIX = 128
#: Bits of a bitmap of surviving codes: 262,144 rows of 16 bytes at most.
BITS = 1 << 24


def normalised(text: Column) -> Column:
    """``text`` with A-Z in lower case and null as the empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _one(bit: Column) -> Column:
    """A long with one bit set: that of ``bit`` in its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def _bitmap(codes: DataFrame) -> DataFrame:
    """(_word, _bits): the bits of all ``code`` (long)."""
    bit = F.pmod("code", F.lit(BITS))
    at = codes.select(F.shiftright(bit, 6).alias("_word"), _one(bit).alias("_set"))
    return written(at.groupBy("_word").agg(F.bit_or("_set").alias("_bits")))


def _flagged(rows: DataFrame, code: Column, bitmap: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether the bit of ``code`` is set."""
    bit = F.pmod(code, F.lit(BITS))
    joined = rows.join(F.broadcast(bitmap), F.shiftright(bit, 6) == F.col("_word"), "left")
    return joined.withColumn(flag, F.coalesce(F.col("_bits").bitwiseAND(_one(bit)) != 0, F.lit(False))).drop("_word", "_bits")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``keep_id`` (largest id of the rows with an equal text), ``group_size`` (their number) and ``kept``.

    Every row comes back.  Null and empty texts are one group.  Rows without an id never stay, unless no equal text has an id
    (``keep_id`` is null then).  Rows that repeat an id along with its text are the same document: they count in
    ``group_size`` and stay or go together.  Rows of one id with different texts are told apart.  Texts may be of any
    length.  An empty table gives no rows.  Names of other columns don't matter, those of the three results apart.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(reversed(docs.columns), reversed(names), strict=True)}
    rows = docs.toDF(*names)
    raw = F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))
    size, start = F.octet_length(raw).cast("long"), F.xxhash64(F.octet_length(raw), normalised(F.substring(raw, 1, PREFIX)))
    doc_id = F.col(at[id_col]).cast("long")

    def twice(codes: DataFrame) -> DataFrame:
        return codes.groupBy("code").agg(F.count("*").alias("_n")).where("_n > 1").select("code")

    lengths = _bitmap(twice(rows.select(size.alias("code"))))
    same_length = _flagged(rows, size, lengths, "_same").where("_same")
    starts = _bitmap(twice(same_length.select(start.alias("code"))))
    left = _flagged(rows, start, starts, "_same").where("_same")
    full = F.sha2(normalised(F.col(at[text_col])), 256)
    groups = left.select(full.alias("_full"), doc_id.alias("_id")).groupBy("_full").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
    groups = written(groups.where("_n > 1"))

    # Texts without a twin have a key of their own that no group has, spread over all tasks.
    alone = F.concat(F.lit("alone "), F.xxhash64(doc_id, F.length(raw)).cast("string"))
    keyed = _flagged(rows, start, starts, "_same").select(*names, F.when(F.col("_same"), full).otherwise(alone).alias("_key"))
    joined = keyed.join(groups, F.col("_key") == F.col("_full"), "left")
    keep = F.when(F.col("_n").isNull(), doc_id).otherwise(F.col("_keep"))
    out = joined.select(*names, keep.alias("_k"), F.coalesce("_n", F.lit(1)).cast("long").alias("_g"), doc_id.eqNullSafe(keep).alias("_s"))
    return out.toDF(*docs.columns, "keep_id", "group_size", "kept")
