"""Line deduplication in content-defined chunks of lines.

A line's code is the start of its MD5; a rolling hash of two neighbouring codes marks about one line in
four.  A chunk ends after a marked line that doesn't follow another marked line, so chunks have at least two lines
(but for a document's last) and their bounds depend on the lines around them only: text inserted above
shifts no bound below.

Chunks of two or more lines that occur more than once in the corpus are removed but for their first
occurrence (smallest document id, then position).  Hashes only choose candidates; what is removed has been grouped by
its bytes.  All steps gather per chunk or per document with sums before the shuffle, so a passage that stands in
a third of all documents makes no hot task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climo.llm.tables import written
from climo.session import ship_package

#: Rolling hash of two line codes: (code before * MULTIPLIER + code) mod MARK_ONE_IN; 0 marks a line.
MULTIPLIER, MARK_ONE_IN = 31, 4


def chunk_bounds(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after) of each chunk."""
    codes = np.fromiter((int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") for x in lines), np.int64, len(lines))
    before = np.concatenate([[0], codes[:-1]])
    marked = (before * MULTIPLIER + codes) % MARK_ONE_IN == 0
    ends = np.flatnonzero(marked & ~np.concatenate([[False], marked[:-1]])) + 1
    bounds = [0, *ends.tolist()]
    if bounds[-1] != len(lines):
        bounds.append(len(lines))
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def text_chunks(text: str) -> Iterator[tuple[int, str]]:
    """(chunk number, chunk) of the chunks that may be removed: two lines or more, with a word."""
    lines = text.split("\n")
    if len(lines) < 2:
        return
    for i, (a, b) in enumerate(chunk_bounds(lines)):
        if b - a > 1:
            chunk = "\n".join(lines[a:b])
            if chunk.strip(" \t\n\x0b\x0c\r"):
                yield i, chunk


def without_chunks(text: str, removed) -> str:
    """The text's lines that lie in none of the chunks ``removed`` (numbers)."""
    lines, gone = text.split("\n"), set(removed)
    kept = [x for i, (a, b) in enumerate(chunk_bounds(lines)) if i not in gone for x in lines[a:b]]
    return "\n".join(kept)


def _chunk_codes(texts: DataFrame) -> DataFrame:
    """(id, version, chunk, code) of (id, version, text)."""
    schema = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("chunk", pa.int32()), ("code", pa.int64())])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, v, n, xxhash.xxh3_64_intdigest(c.encode()) - (1 << 63))
                    for i, v, t in zip(ids, versions, batch.column(2), strict=True) for n, c in text_chunks(t.as_py() or "")]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return texts.mapInArrow(codes, "id long, version long, chunk int, code long")


def _chunk_bytes(texts: DataFrame) -> DataFrame:
    """(id, version, chunk, bytes) of the numbered chunks of (id, version, text, chunks)."""
    schema = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("chunk", pa.int32()), ("bytes", pa.binary())])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for i, v, t, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                    keep = set(wanted.as_py())
                    rows += [(i, v, n, c.encode()) for n, c in text_chunks(t.as_py() or "") if n in keep]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return texts.mapInArrow(chosen, "id long, version long, chunk int, bytes binary")


def _version(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text.cast("string"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, version, chunks): per text of a document the numbers of the chunks that are copies of an earlier chunk.

    ``version`` is null where the id has one text only, as it should: the table stays small.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("id"), _version(docs[text_col]).alias("version"),
                        docs[text_col].cast("string").alias("text"))
    codes = written(_chunk_codes(texts))
    twice = codes.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    wanted = codes.join(written(twice), "code").groupBy("id", "version").agg(F.collect_set("chunk").alias("chunks"))
    bodies = written(_chunk_bytes(texts.join(wanted, ["id", "version"]).select("id", "version", "text", "chunks")))
    place = F.struct("id", "version", "chunk")
    first = bodies.groupBy("bytes").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    copies = bodies.join(written(first.where("n > 1").select("bytes", "first")), "bytes").where(place != F.col("first"))
    gone = copies.groupBy("id", "version").agg(F.collect_set("chunk").alias("chunks"))
    several = texts.groupBy("id").agg(F.min("version").alias("_low"), F.max("version").alias("_high")).where("_low <> _high")
    told = gone.join(written(several.select("id", F.lit(True).alias("_several"))), "id", "left")
    return written(told.select("id", F.when(F.col("_several"), F.col("version")).alias("version"), "chunks"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text_col``, and ``removed_chunks`` (their number).

    Null and empty texts, and texts of one line, stay as they are.  A text may become empty.  Rows that repeat an id along
    with its text are treated alike: the first occurrence stands in all of them.  Different texts of one id are
    documents of their own, ordered by a hash of the text.  Rows without an id keep their text.
    Lines end at ``\\n`` and compare byte by byte, white space included.  An empty table gives no rows.  Names of
    other columns don't matter, ``removed_chunks`` apart.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(reversed(docs.columns), reversed(names), strict=True)}
    gone = repeated_chunks(docs, id_col, text_col)
    rows = docs.toDF(*names)
    own = F.col("_version").isNull() | (_version(F.col(at[text_col])) == F.col("_version"))
    same = (F.col(at[id_col]).cast("long") == F.col("_id")) & own
    joined = rows.join(gone.toDF("_id", "_version", "chunks"), same, "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_chunks(t, c) for t, c in zip(texts, chunks, strict=True)], dtype=object)

    text = F.col(at[text_col])
    cut_text = F.when(F.col("chunks").isNull(), text).otherwise(cut(F.when(F.col("chunks").isNotNull(), text), "chunks"))
    out = joined.select(*[cut_text.alias(n) if n == at[text_col] else F.col(n) for n in names],
                        F.coalesce(F.size("chunks"), F.lit(0)).alias("_removed"))
    return out.toDF(*docs.columns, "removed_chunks")
