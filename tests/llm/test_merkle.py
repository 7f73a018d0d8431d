"""The manifest against a plain tree, for many sizes and block heights; versions, proofs and edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from climo.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])])


def fold_tree(leaves):
    """(root, siblings of each leaf) by building all levels."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(at):
            mate = p ^ 1
            paths[i].append((p & 1, level[mate] if mate < len(level) else ""))
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], paths


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *fold_tree([leaf(r) for r in own]))
    root, tops = fold_tree([trees[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            d = leaf(r, int(tampered))
            for odd, mate in path + top:
                d = h(mate, d) if odd else h(d, mate)
            out.append((r[0], leaf(r), subroot, root, h(*[m for _, m in path + top]), d))
    return sorted(out, key=str)


def manifest(docs, **kw):
    return merkle.dataset_manifest(docs, changes={"n_chars": F.col("n_chars") + 1},
                                   where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, **kw)


def got(docs, **kw):
    rows = manifest(docs, **kw).select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("sizes,levels", [((1,), 2), ((1, 1), 1), ((2, 3, 5), 1), ((4, 16, 17), 2), ((63, 1, 9), 1), ((200, 64, 65, 3), 3)])
def test_equals_plain(spark, sizes, levels):
    rows, n = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n * 3 % 1009, f"text {n} é", None if k == 1 else f"l{k}", "s" if n % 3 else None, n if n % 5 else None, "t", 5))
            n += 1
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(docs, levels=levels) == plain(rows)


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, None, None, None, None, None, None), (None, "", None, None, None, None, None), (7, "", "", "", 0, "", 0), (7, "", "", "", 0, "", 0),
            (7, "x" * 300_000, "", "", 1, "", 0), (0, "a", "z", "b", None, "", 0), (0, "a", "z", "b", 4, "", 0), (1, "a", "ä", "b", 4, "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert got(docs, levels=1) == plain(rows)
    assert manifest(docs.limit(0)).count() == 0


def test_versions_copy_only_their_path(spark):
    rows = [(i, f"t{i}", "en", "s", i, "", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    out = manifest(docs, levels=3).collect()
    base = {r.leaf for r in out}
    level = [r.leaf for r in sorted(out, key=lambda r: r.id)]
    while len(level) > 1:
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
        base |= set(level)
    for r in out:
        if zlib.crc32(str(r.id).encode()) % 7 == 0:
            assert len(r.copied) == len(r.path) + 1 and not set(r.copied) & base and r.copied[-1] == r.folded_root != r.root
            assert all(s[1:] in base for s in r.path if s != "=")        # all else is shared with the base tree
        else:
            assert r.copied == [] and r.folded_root == r.root
