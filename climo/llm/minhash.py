"""MinHash near-deduplication with one-permutation hashing.

* A document's distinct word shingles are hashed to 64 bits.  Documents with the same set are one class (its
  smallest id stands for it), so copies meet no one.
* One permutation: a hash's top bits choose one of ``bins`` bins and the smallest hash in a bin is its
  value.  Optimal densification: an empty bin copies the first filled bin in a random order of its own, the
  same for all documents.
* ``rows`` neighbouring bins form a band; classes that agree in a band share a bucket.
* Candidate edges are stars, so their number grows with the members of a bucket: members are compared with the
  bucket's smallest id, and links are confirmed on the full sets.  A star misses a link between two members that
  both lie too far from its centre.  So buckets whose members are in several components get further stars around
  the members with most links so far (the text that the others were made from, if there is one).
* When such a round links nothing new, all members of different components in one bucket are compared: in blocks of bounded size,
  by the counts of the hashes that they share, without emitting the pairs.
* No bucket is cut or sampled: members of one bucket are in one component or were compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climo.llm.blocks import block_groups, block_links
from climo.llm.graph import connected_components
from climo.llm.tables import written
from climo.session import ship_package

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Odd multipliers of the 64-bit mixer (public constants of splitmix64).
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case.  A text with fewer words has its whole sequence
    as one shingle; without words the set is empty.
    """
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    rolled = np.full(n, span, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(span):
            rolled = _mixed(rolled * _M1 + codes[j:n + j])
    return np.unique(rolled)


@cache
def _donor_order(bins: int) -> np.ndarray:
    rng = np.random.default_rng(20170808)
    return np.argsort(rng.random((bins, bins)), axis=1)


def one_permutation_signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The densified signature of a non-empty sorted set; ``bins`` is a power of two."""
    at = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(at, return_index=True)       # sorted: the first hash of a bin is its smallest
    signature = np.zeros(bins, np.uint64)
    signature[filled] = hashes[first]
    full = np.zeros(bins, bool)
    full[filled] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _donor_order(bins)[empty]
        signature[empty] = signature[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return signature


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band of ``rows`` bins."""
    parts = signature.reshape(-1, rows)
    keys = np.arange(1, len(parts) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            keys = _mixed(keys * _M1 + parts[:, j])
    return keys


def document_signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bins: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set, and the band keys (none for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_digest", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py() or "", width)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                bands.append(band_keys(one_permutation_signature(hashes, bins), rows).view(np.int64) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    picked = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return picked.mapInArrow(signatures, "doc_id long, n_shingles long, set_digest binary, bands array<long>")


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, hashes) of (id, text)."""
    schema = pa.schema([("id", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes = [shingle_set(t.as_py() or "", width).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.list_(pa.int64()))], schema=schema)

    return texts.mapInArrow(sets, "id long, hashes array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, linked) of (u, v): compared on the full sets."""
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("_hu")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("_hv")), "v")
    shared = F.size(F.array_intersect("_hu", "_hv"))
    return both.select("u", "v", (F.lit(100 + percent) * shared >= F.lit(percent) * (F.size("_hu") + F.size("_hv"))).alias("linked"))


#: Hashes that two blocks of sets hold at most, about, and what a set counts at least.
BLOCK_HASHES, LEAST_HASHES = 500_000, 500
#: Hashes in more sets than this are counted by matrix products.
OFTEN = 32


def shared_counts(sets: list) -> np.ndarray:
    """The number of common hashes of each two of some sets (sorted distinct hashes); the diagonal is of no use."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(h) for h in sets])
    hashes = np.concatenate([np.asarray(h, np.int64) for h in sets])
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    sizes = np.diff(np.r_[starts, len(hashes)])
    counts = np.zeros(n * n, np.int64)
    for size in range(2, min(OFTEN, n) + 1):                    # few owners: their pairs
        of = starts[sizes == size]
        if len(of):
            holders = owner[of[:, None] + np.arange(size)]
            for i in range(1, size):
                at = (holders[:, :i] * n + holders[:, i:i + 1]).ravel()
                counts += np.bincount(at, minlength=n * n) if len(at) * 8 > n * n else 0
                if len(at) * 8 <= n * n:
                    np.add.at(counts, at, 1)
    counts = counts.reshape(n, n)
    counts += counts.T.copy()
    often = np.flatnonzero(sizes > OFTEN)
    for k in range(0, len(often), 2048):
        part = often[k:k + 2048]
        held = np.zeros((n, len(part)), np.float32)
        for column, s in enumerate(part):
            held[owner[starts[s]:starts[s] + sizes[s]], column] = 1
        counts += np.rint(held @ held.T).astype(np.int64)
    return counts


def _linked_sets(percent: int):
    """For lists of sets the places (a, b) with a < b of those similar by ``percent``."""
    def pairs(sets: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes, shared = np.array([len(h) for h in sets]), shared_counts(sets)
        near = (100 + percent) * shared >= percent * (sizes[:, None] + sizes[None, :])
        yield np.nonzero(np.triu(near, 1))

    return pairs


def _edge(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def class_links(members: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (u, v) that join what all links inside the buckets ``members`` (bucket, id) join: by stars around the smallest id of
    a bucket, then round for round around the id of most links in buckets of several components, while that links anything; then
    by all pairs of different components.

    A round makes one row per member of such a bucket; no centre is met twice by one member.  ``sets_of(ids)`` gives (id, hashes)
    of the ids that share a bucket with another.
    """
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("centre"))
                     .where("members > 1"))
    inside = written(members.join(shared, "bucket"))
    sets = written(sets_of(inside.select("id").distinct()))
    tested = written(_confirmed(inside.where("id <> centre").select(*_edge("id", "centre")).distinct(), sets, percent))
    while True:
        links = tested.where("linked")
        parts = connected_components(links)
        degree = links.select(F.col("u").alias("id")).union(links.select("v")).groupBy("id").agg(F.count("*").alias("degree"))
        known = parts.join(degree, "id")
        placed = inside.where("members > 2").select("bucket", "id").join(known, "id", "left")
        placed = written(placed.select("bucket", "id", F.coalesce("component", "id").alias("component"),
                                       F.coalesce("degree", F.lit(0)).alias("degree")))
        hub = F.max(F.struct("degree", (-F.col("id")).alias("_minus"), "component"))
        split = written(placed.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), hub.alias("_hub"))
                        .where("_low <> _high").select("bucket", (-F.col("_hub._minus")).alias("centre"), F.col("_hub.component").alias("_component")))
        rest = written(placed.join(split, "bucket"))
        pairs = rest.where("component <> _component").select(*_edge("id", "centre")).distinct()
        fresh = written(_confirmed(pairs.join(tested.select("u", "v"), ["u", "v"], "left_anti"), sets, percent))
        tested = written(tested.union(fresh))
        if not fresh.where("linked").limit(1).count():
            break
    weights = sets.select("id", F.greatest(F.size("hashes"), F.lit(LEAST_HASHES)).alias("weight"))
    untested = written(rest.select("bucket", "id", "component").join(weights, "id"))
    links = block_links(block_groups(untested, BLOCK_HASHES // 2), sets.withColumnRenamed("hashes", "item"), _linked_sets(percent))
    return tested.where("linked").select("u", "v").union(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, bins: int = 128, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest id reachable, ``kept`` marks that one.  With the defaults a link at the
    threshold shares no bucket once in 2 * 10^7 times (0.80) or 2 * 10^10 times (0.85).

    A null, empty or blank text has no shingles and is linked with nothing.  A null id is linked with nothing and kept.
    Rows of one id count as one document.  Equal sets are linked whatever their size.  An empty table gives no
    rows.  Other columns are not read.
    """
    ship_package(docs.sparkSession)
    signed = written(document_signatures(docs, id_col, text_col, shingle_words, bins, rows))
    usable = signed.where("doc_id is not null and n_shingles > 0")
    classes = written(usable.groupBy("set_digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"),
                                                           F.min("bands").alias("bands")))
    members = classes.select("id", F.explode("bands").alias("bucket")).distinct()

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
        return _shingle_sets(texts.join(ids, "id").distinct(), shingle_words)

    links = class_links(members, sets_of, percent)
    copies = usable.join(classes.where("copies > 1").select("set_digest", F.col("id").alias("v")), "set_digest")
    parts = connected_components(links)
    of_class = copies.select(F.col("doc_id").alias("id"), F.col("v").alias("_class")).where("id <> _class").distinct()
    through = of_class.join(parts.withColumnRenamed("id", "_class"), "_class", "left").select(
        "id", F.coalesce("component", "_class").alias("component"))
    everyone = parts.union(through).groupBy("id").agg(F.min("component").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(everyone.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that ``near_duplicates`` doesn't keep, with the columns of ``docs``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(reversed(docs.columns), reversed(names), strict=True)}
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.toDF(*names).join(gone, F.col(at[id_col]).cast("long") == F.col("_gone"), "left_anti").toDF(*docs.columns)
