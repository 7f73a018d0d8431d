"""Exact deduplication by refinement against a plain grouping, with collisions at every step, and edge cases."""

import random
import string

from climo.llm import exact

DOCS = "doc_id long, text string, kept_by string, _same long, _key string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for d, t in rows:
        ids = groups[(t or "").translate(LOWER)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, t, keep, len(ids), d == keep))
    return out


def got(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 3, "y") for d, t in rows], DOCS)
    out = exact.exact_duplicates(docs)
    assert out.columns == [*docs.columns, "keep_id", "group_size", "kept"]
    found = out.collect()
    assert all(r.kept_by == "x" and r._same == 3 and r._key == "y" for r in found)
    return [(r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in found]


def test_equals_plain(spark, monkeypatch):
    rng = random.Random(11)
    start = "same start " * 20
    texts = ["".join(rng.choice("abAB éÉ") for _ in range(rng.randrange(4))) for _ in range(150)]
    texts += [start + x for x in ("one", "two", "One", "three", "two ")] * 3          # equal lengths and starts, different ends
    texts += ["É" * 5, "é" * 5, "İstanbul", "i̇stanbul", "K", "k", None, None, "", "ß", "SS"]  # only A-Z change case
    texts += ["long " * 60_000, "LONG " * 60_000, "long " * 59_999 + "lonG!"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for bits in (exact.BITS, 64):                                                     # 64: every code falls on others
        monkeypatch.setattr(exact, "BITS", bits)
        assert sorted(got(spark, rows), key=str) == sorted(plain(rows), key=str)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (3, "b"), (4, "c"), (4, "c"), (5, "d"), (5, "e"), (7, None), (6, "")]
    assert sorted(got(spark, rows), key=str) == sorted(plain(rows), key=str)
    assert (4, "c", 4, 2, True) in got(spark, rows) and (None, "a", None, 2, True) in got(spark, rows)
    assert exact.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_only_survivors_are_hashed_in_full(spark):
    """The plan compares lengths and starts before it hashes a whole text, and shuffles no text for it."""
    docs = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id long, text string")
    out = exact.exact_duplicates(docs)
    assert out.where("group_size > 1").count() == 0
    assert out.where("kept").count() == 50
