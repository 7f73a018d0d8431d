"""Line deduplication against a plain version, shift resistance, edge cases."""

import random

from climo.llm import lines

DOCS = "doc_id long, text string, chunks string, id long"


def plain(rows):
    seen, out = {}, []
    chunks = {(d, n): c for d, t in rows for n, c in lines.text_chunks(t or "")}
    for key in sorted(chunks):
        seen.setdefault(chunks[key], key)
    for d, t in rows:
        gone = [n for n, c in lines.text_chunks(t or "") if seen[c] != (d, n)]
        out.append((d, lines.without_chunks(t, gone) if gone else t, len(gone)))
    return out


def test_equals_plain(spark):
    rng = random.Random(2)
    passage = [f"shared line {i}" for i in range(40)]
    rows = []
    for d in rng.sample(range(1000), 60):
        own = [f"doc {d} line {i}" for i in range(rng.randrange(0, 12))]
        k = rng.randrange(len(own) + 1)
        rows.append((d, "\n".join(own[:k] + (passage if rng.random() < 0.6 else []) + own[k:])))
    rows += [(2000, None), (2001, ""), (2002, "one line"), (2003, "one line"), (2004, "\n\n\n\n\n\n\n\n"), (2005, "\n\n\n\n\n\n\n\n"),
             (2006, "same\n" * 5000), (2007, "x\ny\n" + "same\n" * 5000), (2008, "\n".join(passage)), (2009, "\n".join(passage))]
    docs = spark.createDataFrame([(d, t, "keep", 7) for d, t in rows], DOCS)
    left = lines.dedup_lines(docs)
    assert left.columns == [*docs.columns, "removed_chunks"]
    got = sorted((r[0], r[1], r[4]) for r in left.collect())
    assert got == sorted(plain(rows))
    assert all(r.chunks == "keep" and r.id == 7 for r in left.collect())
    by_id = {d: (t, n) for d, t, n in got}
    assert by_id[2009] == ("", len(list(lines.text_chunks("\n".join(passage))))) or by_id[2009][1] > 5
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "\n".join(f"line {i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a", 0), (1, text, "a", 0), (None, text, "a", 0), (5, text, "a", 0)], DOCS)
    got = {(r.doc_id, r.removed_chunks > 0) for r in lines.dedup_lines(docs).collect()}
    assert got == {(1, False), (None, False), (5, True)} or got == {(1, True), (None, False), (5, True)}


def test_bounds_resist_shifts():
    rng = random.Random(8)
    body = [f"line {rng.random()}" for _ in range(400)]
    bounds = {lines.chunk_bounds(body)[i][0] for i in range(len(lines.chunk_bounds(body)))}
    moved = {a - 7 for a, _ in lines.chunk_bounds([f"new {i}" for i in range(7)] + body)}
    assert len(bounds ^ {m for m in moved if m > 0}) <= 3
    sizes = [b - a for a, b in lines.chunk_bounds(body)]
    assert min(sizes[:-1]) >= 2


def test_texts_of_one_id_are_told_apart(spark):
    shared, unique = "\n".join(f"line {i}" for i in range(30)), "\n".join(f"other {i}" for i in range(30))
    docs = spark.createDataFrame([(0, shared, "a", 0), (1, unique, "a", 0), (1, shared, "a", 0)], DOCS)
    left = {(r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()}
    assert (0, shared) in left and (1, unique) in left and len(left) == 3
