"""Packing (brute-force round trip of the ids) and mixing (budgets, edge cases)."""

import struct
import zlib

import numpy as np
import pytest

from climo.llm import mixing, packing
from climo.llm.tokens import TextEncoder, default_ranks_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def encoder():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", None, "a", "word " * 3000, "  two  spaces \n\n and\ttabs ", "x" * 5000, "café 中文 \U0001f600 ok",
         "<|endoftext|> is text", "it's 12,345.67 don't stop \x1c odd", "\n lead", "trail ", "a b\nc d\n"]


def check_pieces(rows, texts_by_id, max_tokens):
    encode = encoder()
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    assert set(docs) == set(texts_by_id)
    for doc_id, text in texts_by_id.items():
        want = encode(text or "") + [1]
        at = 0
        for r in sorted(docs[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.length > 0
            assert bytes(r.ids) == struct.pack(f"<{r.length}I", *want[at:at + r.length])
            at += r.length
        assert at == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for ps in sequences.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens and at == ps[0].sequence_tokens
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    return padding


@pytest.mark.parametrize("window", [1 << 20, 600])
def test_pack_round_trip(spark, window):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)], DOCS).repartition(2)
    rows = packing.pack_documents(docs, max_tokens=256, window_tokens=window).collect()
    assert check_pieces(rows, dict(enumerate(TEXTS)), 256) == 0


def test_pack_repeated_null_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "c", 5)], "doc_id long, text string, length long")
    rows = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or -1) for r in rows if r.start == 0) == [-1, 1, 1]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_costs_are_balanced():
    pieces = [(i, 0, n) for i, n in enumerate([900, 800, 700, 300, 200, 100] * 20)]
    total = sum(p[2] for p in pieces)
    held, left = packing.assign_pieces(pieces, packing.sequence_capacities(total, 1000, last=False))
    assert sum(p[2] for p in left) == total % 1000
    assert all(sum(p[2] for p in s) == 1000 for s in held)
    costs = [sum(packing.attention_cost(p[2]) for p in s) for s in held]
    assert max(costs) / min(costs) < 1.6


def test_targets_water_filling(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), (None, 1000), ("c", 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # weights a=1 b=2 c=3 null=1 of 7 over 1115 words; b and c stop at 30 and 15, the rest is shared again
    assert got["b"] == 30 and got["c"] == 15
    assert got["a"] == 300 and got[None] == pytest.approx(770)


def test_mix_counts_and_edges(spark):
    rows = [(i, "w " * (5 + i % 7), "en", f"s{i % 3}" if i % 11 else None, 0) for i in range(400)]
    rows += [(1000, None, None, "s0", 0), (1001, "", "en", "empty", 0), (None, "x y", "en", "s1", 0), (3, "w " * 8, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(docs)
    got = out.collect()
    assert len(got) == len(rows)
    for size, target, taken in out.groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(taken - target) <= 11, (size, target, taken)
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(docs.repartition(3)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_special_token_as_the_tokenizer_has_it(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    plain = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y z", "<|endoftext|", "end <|endoftext|>", "no token"]
    coder = TextEncoder(default_ranks_path(), specials=True)
    for text in texts:
        assert np.frombuffer(coder.ids_bytes(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.doc_tokens for r in packing.pack_documents(docs, specials=True).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_many_sources_mix_as_few_do(spark, monkeypatch):
    """Beyond the broadcast limit sources are salted: the same rows, with a hot source, a null one and repeated rows."""
    rows = [(i % 390, " ".join(["w"] * (i % 17)), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = [sorted(map(str, f(docs).collect())) for f in (mixing.mixed_documents, mixing.mix)]
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert "_salt" in mixing.mixed_documents(docs)._jdf.queryExecution().analyzed().toString()
    assert few == [sorted(map(str, f(docs).collect())) for f in (mixing.mixed_documents, mixing.mix)]
