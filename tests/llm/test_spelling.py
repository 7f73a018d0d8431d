"""Spelling variants against brute force over all pairs of words; shards in blocks, chains of forms, edge cases."""

import random
import re
import string
import zlib
from collections import Counter

import numpy as np

from climo.llm import spelling

DOCS = "doc_id long, text string, word string, n long, key long"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(rows):
    found = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            x = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if x % 199 == 0:
                run = run[:x % len(run)] + run[x % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    n = words_of(rows)
    forms, counts = {}, {}
    for w in n:
        mates = [v for v in n if near(w, v)]
        best = min(mates, key=lambda v: (-n[v], v), default=None)
        counts[w] = len(mates)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], counts[w], n[forms[w]] if forms[w] else None))
    return sorted(out)


def corpus(seed, n_words=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀ÷") for _ in range(rng.randrange(5, 9))) for _ in range(n_words)]
    bag = [(w, 5 ** rng.randrange(1, 4)) for w in base]
    for w in base:
        i = rng.randrange(len(w))
        bag += [(w[:i] + w[i + 1:], 5), (w[:i] + "x" + w[i:], 6), (w[:i] + "z" + w[i + 1:], 25), (w[i:] + w[:i], 5)]
    long = "pneumono" * 4_000
    bag += [(long, 5), (long + "n", 30), (long[:100] + "q" + long[101:], 5), ("q" + long[2:] + "a", 5), ("anagram", 5), ("margana", 5),
            ("chainlet", 5), ("chainlets", 30), ("chainletss", 200)]
    rows = []
    for i, (w, k) in enumerate(bag):
        rows += [(i * 31 + j % 7, " ".join([w if j % 2 else w.swapcase() if w.isascii() else w] * 5)) for j in range(max(1, k // 5))]
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(1) + [(None, None), (3, ""), (4, "1234 -- ½"), (None, "nulled nulled nulled nulled nulled")]
    docs = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in rows], DOCS).repartition(4)
    want = plain(rows)
    assert any(r[2] != (r[1] or r[0]) for r in want)                       # chains of more than one form
    for block, leaf in ((50_000, 16), (3, 1)):                             # 3: every shard in blocks
        monkeypatch.setattr(spelling, "BLOCK", block)
        monkeypatch.setattr(spelling, "LEAF", leaf)
        out = spelling.spelling_variants(docs)
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]) == want
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_trie_finds_all_pairs():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abqé") for _ in range(rng.randrange(6, 9))) for _ in range(700)})
    vectors, all_of = spelling._vectors(words), np.arange(len(words))
    got = {(words[a], words[b]) for p, q in spelling.near_pairs(words, vectors, all_of, all_of) for a, b in zip(p, q, strict=True)}
    assert got == {(a, b) for a in words for b in words if near(a, b)}
    assert all(spelling.one_edit(a, b) == near(a, b) for a in words[:60] for b in words)
