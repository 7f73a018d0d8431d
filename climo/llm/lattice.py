"""Near-duplicate vectors by lattice hashing.

Random projections take a unit vector to points of 8-dimensional space, which are decoded to the nearest point
of the lattice E8.  A table joins two such points to one cell; there are several tables.  A vector is at home in its own cell
of each table and also probes the neighbouring cells nearest to it.

Equal vectors are one class.  What is compared:

1. members of one cell with the cell's smallest id (stars, so pairs grow with the members);
2. vectors with those at home in a cell that they probe, where the two aren't already connected;
3. all members of different components that are at home in one cell, in blocks of bounded size;
4. all members of each connected component, in blocks of bounded size, for the exact number of links of each vector.

Every link is confirmed by the cosine in double precision; nothing emits the pairs within a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climo.llm.blocks import block_groups, block_links, split_buckets
from climo.llm.graph import connected_components
from climo.llm.tables import written
from climo.session import ship_package

_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    pairs = [np.bincount([i, j], [a, b], 8) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def _nearest_even_sum(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum (D8): where rounding gives an odd sum, the coordinate that was
    rounded furthest is rounded the other way."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 + 1/2."""
    whole, half = _nearest_even_sum(y), _nearest_even_sum(y - 0.5) + 0.5
    closer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _point_codes(points: np.ndarray) -> np.ndarray:
    """64-bit codes of lattice points (any leading shape)."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    code = np.full(points.shape[:-1], 0x243F6A8885A308D3, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(8):
            code = (code ^ doubled[..., i]) * _MIX
            code ^= code >> np.uint64(29)
    return code


def table_cells(units: np.ndarray, table: int, scale: float, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, probed cells) of unit vectors in one table: two lattice points joined to one code."""
    rng = np.random.default_rng([seed, table, units.shape[1]])
    homes, options = [], []
    for _ in range(2):
        y = units @ (rng.standard_normal((units.shape[1], 8)) * scale)
        point = decode_e8(y)
        nearest = np.argsort(-((y - point) @ shortest_vectors().T), axis=1, kind="stable")[:, :probes]
        homes.append(_point_codes(point))
        around = point[:, None, :] + shortest_vectors()[nearest]
        options.append(np.concatenate([homes[-1][:, None], _point_codes(around)], axis=1))
    with np.errstate(over="ignore"):
        join = lambda a, b: (a * _MIX + b) * _MIX + np.uint64(table)
        cells = join(options[0][:, :, None], options[1][:, None, :]).reshape(len(units), -1)
    return cells[:, 0], cells[:, 1:]


def _cells(classes: DataFrame, tables: int, scale: float, probes: int, seed: int, home: bool) -> DataFrame:
    """(bucket, id, component) per class and table: its own cell, or the cells that it probes."""
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("component", pa.int64())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000).to_pandas()
                for (label, size), rows in part.groupby(["label", part.embedding.map(len)]):
                    x = np.vstack(rows.embedding.to_numpy()).astype(float)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    units = x / np.linalg.norm(x, axis=1, keepdims=True)
                    salt = np.uint64((int(label) * 0x100000001B3 + int(size)) & (2**64 - 1))
                    for table in range(tables):
                        own, probed = table_cells(units, table, scale, probes, seed)
                        found = own[:, None] if home else probed
                        with np.errstate(over="ignore"):
                            buckets = ((found ^ salt) * _MIX).view(np.int64).ravel()
                        n = found.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.repeat(rows.id.to_numpy(), n)),
                                                          pa.array(np.repeat(rows.component.to_numpy(), n))], schema=schema)

    return classes.select("id", "label", "embedding", "component").mapInArrow(cells, "bucket long, id long, component long")


def _scaled(x: Column) -> Column:
    """A finite non-zero vector over its largest magnitude, so that no square over- or underflows."""
    most = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    return F.transform(x, lambda v: v.cast("double") / most)


def _cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _confirmed(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose labels are equal and whose cosine reaches the threshold."""
    left = pairs.join(classes.select(F.col("id").alias("u"), _scaled(F.col("embedding")).alias("_a"), F.col("label").alias("_l")), "u")
    both = left.join(classes.select(F.col("id").alias("v"), _scaled(F.col("embedding")).alias("_b"), F.col("label").alias("_m")), "v")
    same = (F.col("_l") == F.col("_m")) & (F.size("_a") == F.size("_b"))
    return both.where(same & (_cosine(F.col("_a"), F.col("_b")) >= threshold)).select("u", "v")


def _link_counts(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, linked): per class the rows of other classes of its component within the threshold.

    ``members`` (id, component, copies, embedding).  A component is dealt to blocks of about ``block`` members;
    each pair of blocks is one group, so a group holds two blocks at most however large a component is.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("_n"))
    sized = members.join(sizes, "component").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    dealt = sized.withColumn("_at", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    groups = dealt.withColumn("_other", other).select(
        "component", F.least("_at", "_other").alias("_i"), F.greatest("_at", "_other").alias("_j"), "_at", "id", "copies", "embedding")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(rows.embedding.to_numpy()).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        norms = np.sqrt((x * x).sum(axis=1))
        copies, at, (i, j) = rows.copies.to_numpy(), rows._at.to_numpy(), (rows._i.iloc[0], rows._j.iloc[0])
        linked = np.zeros(len(rows), np.int64)
        columns = np.arange(len(rows))
        for k in range(0, len(rows), 512):
            near = (x[k:k + 512] @ x.T) / (norms[k:k + 512, None] * norms[None, :]) >= threshold
            near[np.arange(len(near)), columns[k:k + 512]] = False
            if i != j:
                near &= at[k:k + 512, None] != at[None, :]
            linked[k:k + 512] = near @ copies
        return pd.DataFrame({"id": rows.id, "linked": linked})

    partial = groups.groupBy("component", "_i", "_j").applyInPandas(count, "id long, linked long")
    return partial.groupBy("id").agg(F.sum("linked").alias("linked"))


def _near_pairs(threshold: float):
    """For lists of (label, *vector) the places (a, b) with a < b of equal labels whose cosine reaches the threshold, in stretches."""
    def pairs(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kinds = np.array([(v[0], len(v)) for v in vectors])
        for kind in np.unique(kinds, axis=0):
            places = np.flatnonzero((kinds == kind).all(axis=1))
            x = np.vstack([vectors[p][1:] for p in places]).astype(float)
            x /= np.abs(x).max(axis=1, keepdims=True)
            norms = np.sqrt((x * x).sum(axis=1))
            for k in range(0, len(x), 512):
                near = (x[k:k + 512] @ x[k:].T) / (norms[k:k + 512, None] * norms[None, k:]) >= threshold
                a, b = np.nonzero(np.triu(near, 1))
                yield places[a + k], places[b + k]

    return pairs


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                           threshold: float = 0.93, tables: int = 8, scale: float = 0.6, probes: int = 4, seed: int = 5,
                           block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors are compared within equal, non-null labels and equal lengths.  With the defaults a pair at the
    threshold meets in some cell with a probability of about 0.9996, closer pairs more surely.  All pairs that meet are
    compared unless they are connected already; all pairs inside a component are then compared.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without label or id, are linked
    with nothing; rows without id are kept.  Rows with equal vectors and labels are linked, repeated rows among
    them.  Components of any finite size are compared by direction.  An id should name one vector.  An empty table gives no rows.  Other columns are not read.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"),
                          vectors[label_col].cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where("vec_id is not null and label is not null and size(embedding) > 0").where(
        finite & F.exists("embedding", lambda x: x != 0))
    classes = written(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    alone = classes.withColumn("component", F.col("id"))
    homes = written(_cells(alone, tables, scale, probes, seed, home=True))
    stars = homes.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1")
    near = homes.join(written(stars), "bucket").where("id <> centre").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct()
    first = written(_confirmed(near, classes, threshold))
    parts = connected_components(first)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(parts.withColumnRenamed("component", "_part"), "id", "left").withColumn(
            "component", F.coalesce("_part", "component")).drop("_part")

    guests = _cells(placed(alone), tables, scale, probes, seed, home=False)
    hosts = placed(homes).select("bucket", F.col("id").alias("host"), F.col("component").alias("_of"))
    met = guests.join(hosts, "bucket").where("component <> _of")
    crossing = met.select(F.least("id", "host").alias("u"), F.greatest("id", "host").alias("v")).distinct()
    links = written(first.union(_confirmed(crossing, classes, threshold)))
    parts = connected_components(links)
    untested = written(split_buckets(placed(homes)).withColumn("weight", F.lit(1)))
    vectors_of = classes.select("id", F.concat(F.array(F.col("label").cast("double")), "embedding").alias("item"))
    parts = connected_components(links.union(block_links(block_groups(untested, block), vectors_of, _near_pairs(threshold))))
    members = classes.join(parts, "id")
    counts = _link_counts(members, threshold, block)
    totals = written(classes.where("copies > 1").select("id", "copies").join(parts, "id", "full").join(counts, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")))
    copies = usable.join(classes.where("copies > 1").select("label", "embedding", F.col("id").alias("_class")), ["label", "embedding"])
    of_copies = copies.where("vec_id <> _class").select(F.col("vec_id").alias("id"), "_class").distinct()
    through = of_copies.join(totals.withColumnRenamed("id", "_class"), "_class").select("id", "component_id", "n_links")
    everyone = totals.union(through).groupBy("id").agg(F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    out = rows.select("vec_id").join(everyone.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
