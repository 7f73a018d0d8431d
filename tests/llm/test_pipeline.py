"""Every stage of the corpus pipeline against a plain version of its work on its own input."""

import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from test_lines import plain as plain_lines
from test_minhash import brute
from test_packing_mixing import encoder

import corpus_pipeline
from climo.llm import mixing, oracle
from climo.llm.tables import table, written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = written(table(spark, SF, "documents"))
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(written(f(spark, out[-1], SF)))
    return out


def test_stages_keep_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "mix_sources", "pack_sequences"]
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_quality_and_lines(stages):
    con = duckdb.connect()
    con.register("documents", stages[0].toPandas())
    kept = {d for d, k in con.sql(f"SELECT doc_id, kept FROM ({oracle.quality_sql()})").fetchall() if k}
    rows = {r.doc_id: r.text for r in stages[1].collect()}
    assert set(rows) == kept and 0 < len(kept) < stages[0].count()
    want = {d: t for d, t, n in plain_lines(sorted(rows.items())) if not n or WORD.search(t)}
    got = {r.doc_id: r for r in stages[2].collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text != rows[r.doc_id])


def test_near_duplicates_and_mix(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    keep = {d for d, _, c in brute(rows, 5, 80) if d == c}
    assert {str(r.doc_id) for r in stages[3].collect()} == keep
    copies = {r.doc_id: r.copies for r in mixing.mixed_documents(stages[3]).collect()}
    mixed = Counter(r.doc_id for r in stages[4].collect())
    assert {d: n for d, n in copies.items() if n} == dict(mixed)
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    assert all(r.text == texts[r.doc_id] for r in stages[4].collect())


def test_packing(stages):
    encode = encoder()
    want = Counter()
    for r in stages[4].collect():
        want[r.doc_id] += 1
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    pieces = stages[5].collect()
    for d, n in want.items():
        ids = encode(texts[d] or "") + [1]
        own = [p for p in pieces if p.doc_id == d]
        assert sum(p.length for p in own) == n * len(ids)
        assert all(p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start:p.start + p.length])) for p in own)
    at = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0)
        at[p.sequence_id] = p.offset + p.length
    assert max(at.values()) <= 2048


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", removed_chunks int, _gone long, _rejected long, _text_hash long, chunks string, component string"


def test_edge_cases_in_every_stage(spark):
    """Nulls, empty and blank texts, repeated rows, two texts of one id, and columns named like the stages' own."""
    prose = " ".join(f"word{i % 37} and some{i % 11} more" for i in range(80))
    rows = [(None, prose, "en", "s", 5), (1, None, None, None, None), (2, "", "", "", 0), (3, " \n\t", "en", "s", 4), (4, prose + " x", "en", None, 9),
            (4, prose + " x", "en", None, 9), (5, "\n".join([prose] * 3), "en", "s", 1), (5, "the other text of it " + prose[::-1], "xx", "t", 2)]
    for table_rows in (rows, []):
        docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "c", "d") for r in table_rows], DOCS + EXTRA)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, SF))
            assert out.columns == docs.columns
            assert all(r.removed_chunks == 1 and r.component == "d" for r in out.collect())
        whole = docs
        for _, stage in corpus_pipeline.STAGES:
            whole = written(stage(spark, whole, SF))
        assert (whole.count() > 0) == bool(table_rows)


def test_rejection_depends_on_the_language(spark, monkeypatch):
    """A row goes only for its own verdict, not for that of the same text under another language."""
    docs = spark.createDataFrame([(1, "t", "en", "s", 1), (1, "t", "de", "s", 1)], DOCS)
    verdicts = spark.createDataFrame([(1, "t", "en", True), (1, "t", "de", False)], "doc_id long, t string, lang string, kept boolean")
    from pyspark.sql import functions as F

    from climo.llm import quality
    monkeypatch.setattr(quality, "score_documents", lambda *a, **k: verdicts.withColumn("text_hash", F.xxhash64("t")))
    assert [r.lang for r in quality.keep_documents(docs).collect()] == ["en"]
