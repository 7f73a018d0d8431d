"""All pairs of different components inside buckets, in groups of bounded size, without emitting the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climo.llm.tables import written


def split_buckets(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (bucket, id, component, ...) in buckets of more than two members that hold several components."""
    split = members.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n"))
    return members.join(split.where("_low <> _high and _n > 2").select("bucket"), "bucket")


def block_groups(members: DataFrame, block: int) -> DataFrame:
    """(pack, i, j, bucket, at, id, component): groups (pack, i, j) that bring together all pairs of one bucket and different
    components.

    ``members`` (bucket, id, component, weight).  A bucket is dealt to blocks of about ``block`` weight and each pair of blocks is
    a group.  A component that fills blocks has its own, which aren't paired with each other, so it is repeated only for
    the blocks of strangers.  Buckets of one block are packed together to about one block each.
    """
    parts = members.groupBy("bucket", "component").agg(F.sum("weight").alias("_w")).withColumn("_big", F.col("_w") > block)
    total = F.sum(F.when(~F.col("_big"), F.col("_w")))
    rest = parts.groupBy("bucket").agg(F.ceil(F.coalesce(total, F.lit(0)) / block).cast("int").alias("_small"))
    own = parts.where("_big").withColumn("_own", F.ceil(F.col("_w") / block).cast("int"))
    last = F.sum("_own").over(Window.partitionBy("bucket").orderBy("component").rowsBetween(Window.unboundedPreceding, 0))
    own = own.join(rest, "bucket").withColumn("_from", (F.col("_small") + last - F.col("_own")).cast("int"))
    wide = own.groupBy("bucket").agg(F.sum("_own").cast("int").alias("_more"))
    layout = written(rest.join(wide, "bucket", "left").select("bucket", "_small", (F.col("_small") + F.coalesce("_more", F.lit(0))).alias("_blocks")))
    placed = members.join(layout, "bucket").join(own.select("bucket", "component", "_from", "_own"), ["bucket", "component"], "left")
    dealt = placed.withColumn("at", F.when(F.col("_own").isNull(), F.pmod(F.xxhash64("id"), F.col("_small"))).otherwise(
        F.col("_from") + F.pmod(F.xxhash64("id"), F.col("_own"))).cast("int"))
    mine = F.col("_own").isNotNull()
    others = F.filter(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: ~F.coalesce(
        mine & (b >= F.col("_from")) & (b < F.col("_from") + F.col("_own")), F.lit(False)))
    paired = dealt.withColumn("_other", F.explode(others))
    single = layout.where("_blocks = 1")
    weight = members.join(single.select("bucket"), "bucket").agg(F.sum("weight")).collect()[0][0] or 0
    alone = F.col("_blocks") == 1
    packs = int(weight // block) + 1
    return paired.select(F.when(alone, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.col("bucket")).alias("pack"),
                         F.when(alone, -1).otherwise(F.least("at", "_other")).alias("i"),
                         F.when(alone, -1).otherwise(F.greatest("at", "_other")).alias("j"), "bucket", "at", "id", "component")


def _forest(links: Iterator[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, components: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (places, other places) those that join what wasn't joined by earlier ones: (id, id)."""
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while up.get(c, c) != c:
            up[c] = up.get(up[c], up[c])
            c = up[c]
        return c

    out = []
    for a, b in links:
        codes = np.stack([components[a], components[b]], axis=1)
        for n in np.unique(codes, axis=0, return_index=True)[1] if len(codes) else ():
            x, y = top(int(codes[n, 0])), top(int(codes[n, 1]))
            if x != y:
                up[x] = y
                out.append((int(ids[a[n]]), int(ids[b[n]])))
    return out


def block_links(groups: DataFrame, payload: DataFrame, linked: Callable[[list], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Links (u, v) that join the components as all links inside the buckets would; ``payload`` (id, item).

    ``linked(items)`` gives stretches of the places (a, b) of all linked pairs of items; per group only the links of a
    spanning forest of its components leave the task.
    """
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket", kind="stable")
        buckets, at = rows.bucket.to_numpy(), rows["at"].to_numpy()
        ids, components, items = rows.id.to_numpy(), rows.component.to_numpy(), rows.item.to_list()
        same = rows.i.iloc[0] == rows.j.iloc[0]
        bounds = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(rows)]
        out = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            c, blocks = components[s:e], at[s:e]
            if (c == c[0]).all():
                continue

            def crossing(s=s, e=e, c=c, blocks=blocks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for a, b in linked(items[s:e]):
                    ok = (c[a] != c[b]) & (same | (blocks[a] != blocks[b]))
                    yield a[ok], b[ok]

            out += _forest(crossing(), ids[s:e], c)
        return pd.DataFrame({"u": np.array([min(p) for p in out], np.int64), "v": np.array([max(p) for p in out], np.int64)})

    return groups.join(payload, "id").groupBy("pack", "i", "j").applyInPandas(compare, "u long, v long").distinct()
