"""MinHash near-deduplication against brute force, and edge cases."""

import random
import re

import numpy as np

from climo.llm import graph, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, bands string, id long"


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    return sorted((str(d), len(sets[i]), str(min(groups[top(i)])) if d is not None else "None")
                  for i, (d, _) in enumerate(rows))


def edited(rng, words, rate):
    return [f"n{rng.random()}" if rng.random() < rate else w for w in words]


def corpus(rng):
    """A hub with edits on either side of the limit, a chain, copies, short and odd texts; ids shuffled."""
    texts = []
    hub = [f"h{rng.randrange(400)}" for _ in range(120)]
    texts += [" ".join(hub)] + [" ".join(edited(rng, hub, 0.022)) for _ in range(60)]
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):
        texts.append(" ".join(chain[i * 6:i * 6 + 130]))
    texts += ["same text here Now"] * 30 + ["SAME  text\there now"] * 3
    texts += ["", None, " \n\t ", "one", "ONE", "two words", "two  words", "\xa0 x y", "long " * 30_000]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_equals_brute_force(spark):
    rng = random.Random(11)
    for width, percent in ((3, 85), (5, 80)):
        rows = corpus(rng)
        rows += [(None, rows[0][1]), rows[3], rows[3]]
        docs = spark.createDataFrame([(d, t, "en", "x", 1) for d, t in rows], DOCS)
        got = minhash.near_duplicates(docs, shingle_words=width, percent=percent).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, width, percent)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    for n in (12, 100, 2000):
        agree = []
        for _ in range(40):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            other = np.concatenate([base[: n * 3 // 4], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)])
            a, b = np.unique(base << np.uint64(1)), np.unique(other << np.uint64(1))
            agree.append((minhash.one_permutation_signature(a, 128) == minhash.one_permutation_signature(b, 128)).mean())
        assert abs(np.mean(agree) - 0.6) < 0.06, (n, np.mean(agree))


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(5, 3), (3, 5), (9, 9), (None, 4), (100, 7), (100, 8), (101, 8)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 3: 3, 5: 3, 9: 9, 100: 7, 7: 7, 8: 7, 101: 7}


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120))) for _ in range(90)]
    got = minhash.shared_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(set(a.tolist()) & set(b.tolist()))


def test_links_in_crowded_buckets(spark, monkeypatch):
    """One bucket: strangers with smaller ids and busier groups, and pairs that only each other can link."""
    rng = random.Random(2)
    sets, n = {}, 0
    for size in [1] * 20 + [4] * 8 + [2] * 15:
        base = rng.sample(range(10 ** 9), 100)
        for _ in range(size):
            sets[n] = sorted([*base, *rng.sample(range(10 ** 9, 2 * 10 ** 9), 3)])
            n += 1
    frame = spark.createDataFrame(sorted(sets.items()), "id long, hashes array<long>")
    members = spark.createDataFrame([(b, i) for i in sets for b in (1, 2)], "bucket long, id long")
    for budget in (500_000, 4000):
        monkeypatch.setattr(minhash, "BLOCK_HASHES", budget)
        links = minhash.class_links(members, lambda ids: frame.join(ids, "id"), 85)
        parts = {r.id: r.component for r in graph.connected_components(links).collect()}
        want, at = {}, 20
        for size in [4] * 8 + [2] * 15:
            want |= {i: at for i in range(at, at + size)}
            at += size
        assert parts == want
