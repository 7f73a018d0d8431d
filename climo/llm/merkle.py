"""Merkle manifest of a dataset: a persistent tree whose versions copy only the path of a changed leaf.

* A leaf is the hash of a row's fields; the leaves of one language, in the order of ids, are a tree, and the trees' roots
  in the order of languages are a tree again.  A node is the hash of two neighbours (of one, at a level's odd end).
* Positions come from a range-partitioned write: numbers inside each written partition plus the rows before it, so
  no task holds a language.
* A tree is cut into aligned blocks of ``2 ** BLOCK_LEVELS`` leaves.  A block is raised in one task; the roots of the blocks are
  the leaves of the next stage, and so on.  Each block then learns the siblings above it, from the top stage down.
* A changed leaf makes a version of the tree: inside its block only the ancestors are copied, every other node is
  shared with the base tree, and the version goes on through the siblings above its block to a root of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climo.llm.tables import written
from climo.session import ship_package

BLOCK_LEVELS = 6
#: The hashed fields of a document, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node_hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    return F.sha2(F.concat(*[F.when(f.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]), 256)


def raised(digests: list[str], height: int) -> list[list[str]]:
    """The levels above ``digests``: ``height`` of them, and more until one node is left."""
    levels = [digests]
    while len(levels[-1]) > 1 or len(levels) <= height:
        below = levels[-1]
        levels.append([node_hash(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """Per level the sibling on leaf ``at``'s path: ``<`` (to the left) or ``>`` and its hash, ``=`` where there is none."""
    path = []
    for level in levels[:-1]:
        mate = at ^ 1
        path.append("=" if mate >= len(level) else ("<" if at & 1 else ">") + level[mate])
        at >>= 1
    return path


def copied_path(leaf: str, path: list[str]) -> list[str]:
    """The nodes of a version that differ from the base tree: the new leaf and its ancestors up to the version's root."""
    nodes = [leaf]
    for step in path:
        nodes.append(node_hash(step[1:], nodes[-1]) if step[0] == "<" else node_hash(nodes[-1], step[1:]))
    return nodes


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in each ``tree``, by ``order``) and ``size`` (rows of the tree)."""
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    stretches = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = stretches.select("tree", "_part", (F.sum("_n").over(upto) - F.col("_n") - F.col("_first")).alias("_shift"),
                               F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    joined = placed.join(written(offsets), ["tree", "_part"])
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, size, nodes) of (tree, pos, size, digest, ...): aligned blocks, nodes in order."""
    rest = [c for c in nodes.columns if c not in ("tree", "pos", "size")]
    dealt = nodes.groupBy("tree", F.shiftright("pos", levels).alias("block"), "size")
    return written(dealt.agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("nodes")))


def _height(size: int, levels: int) -> int:
    """A block of several is raised to its full height; a tree of one block until one node is left."""
    return levels if size > 1 << levels else 0


def _tops(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, block, size, digest): the root of each block."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["tree"], r["block"], r["size"], raised([n["digest"] for n in r["nodes"]], _height(r["size"], levels))[-1][0])
                    for r in batch.to_pylist()]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return blocks.select("tree", "block", "size", "nodes").mapInArrow(tops, "tree string, block long, size long, digest string")


def _node_paths(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, path, root) of each node of (tree, block, size, nodes, above, root): its siblings up to the tree's root."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string())), ("root", pa.string())])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                tree = raised([n["digest"] for n in r["nodes"]], _height(r["size"], levels))
                rows += [(r["tree"], n["pos"], siblings(tree, i) + r["above"], r["root"]) for i, n in enumerate(r["nodes"])]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return blocks.select("tree", "block", "size", "nodes", "above", "root").mapInArrow(paths, "tree string, pos long, path array<string>, root string")


def _above(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, block, above, root): the siblings above each block up to its tree's root, stage by stage."""
    tops = written(_tops(blocks, levels))
    whole = F.col("size") <= 1 << levels
    done = tops.where(whole).select("tree", "block", F.array().cast("array<string>").alias("above"), F.col("digest").alias("root"))
    if tops.where(~whole).limit(1).count() == 0:
        return done
    size = F.shiftright(F.col("size") + ((1 << levels) - 1), levels)
    nodes = tops.where(~whole).select("tree", F.col("block").alias("pos"), size.alias("size"), "digest")
    stage = _blocks(nodes, levels)
    paths = _node_paths(stage.join(_above(stage, levels), ["tree", "block"]), levels)
    return written(done.union(paths.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "root")))


def _leaf_rows(blocks: DataFrame, levels: int) -> DataFrame:
    """Every leaf with its siblings and, where it was changed, the nodes that its version copies."""
    text, texts = pa.string(), pa.list_(pa.string())
    schema = pa.schema([("id", pa.int64()), ("leaf", text), ("subroot", text), ("root", text), ("path", texts), ("copied", texts), ("folded_root", text)])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = []
                for r in batch.slice(at, 100).to_pylist():
                    tree = raised([n["digest"] for n in r["nodes"]], _height(r["size"], levels))
                    for i, n in enumerate(r["nodes"]):
                        path = siblings(tree, i) + r["above"]
                        nodes = copied_path(n["changed"] or n["digest"], path)
                        rows.append((n["id"], n["digest"], r["subroot"], r["root"], path, nodes if n["changed"] else [], nodes[-1]))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return blocks.select("size", "nodes", "above", "subroot", "root").mapInArrow(
        leaves, "id long, leaf string, subroot string, root string, path array<string>, copied array<string>, folded_root string")


def dataset_manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS,
                     changes: dict[str, Column] | None = None, where: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Each row of ``docs`` as a leaf: (id, leaf, subroot, root, path, copied, folded_root).

    ``path`` holds the siblings from the leaf up to ``root`` (see ``siblings``).  ``changes`` (column: its new value) are
    applied to the rows ``where`` holds: such a row's version copies the nodes ``copied``, new leaf first, and
    ``folded_root`` is the version's root.  For other rows ``copied`` is empty and ``folded_root`` is recomputed from the leaf
    and its siblings.  A change that alters no field (null stays null) gives the base root.

    Null fields hash as ``-`` and differ from empty ones.  Rows without a language are a tree of their own, first in
    order; ids ascend, null first.  Rows that share an id are ordered by their hashes, so repeated rows have one leaf
    each and results don't depend on the order of the input.  A lone leaf is its tree's root.  An empty table gives no
    rows.  Texts may be of any length and other columns of any name.
    """
    ship_package(docs.sparkSession)
    lang = docs[tree_col].cast("string")
    old = leaf_hash([docs[f] for f in fields])
    new = leaf_hash([(changes or {}).get(f, docs[f]) for f in fields])
    leaves = written(docs.select(
        F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang)).alias("tree"), docs[id_col].cast("long").alias("id"),
        old.alias("digest"), F.when(F.lit(False) if where is None else where, new).alias("changed")))
    blocks = _blocks(_numbered(leaves, ["id", "digest", "changed"]), levels)
    above = written(_above(blocks, levels))
    subroots = above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    numbered = written(_numbered(written(subroots), ["of"]))
    stage = _blocks(numbered.drop("of"), levels)
    tops = _node_paths(stage.join(_above(stage, levels), ["tree", "block"]), levels)
    tops = numbered.select("of", "pos").join(tops.select("pos", "path", F.col("root").alias("whole")), "pos")
    tops = written(tops.select(F.col("of").alias("tree"), "path", "whole"))
    up = written(above.join(tops, "tree").select("tree", "block", F.concat("above", "path").alias("above"),
                                                  F.col("root").alias("subroot"), F.col("whole").alias("root")))
    return _leaf_rows(blocks.join(up, ["tree", "block"]), levels)


def proof_digest(path: Column) -> Column:
    """Hash of a path's siblings, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substr(s, F.lit(2))), ""), 256)
