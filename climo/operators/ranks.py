"""Ranks, records and top-N.

Ranking follows pandas ``rank(method='min')``: ties share the lowest rank,
NULL values get no rank (Q4).  Top-N with ties never sorts a whole group in
one task: the rank filter becomes a ``WindowGroupLimit`` applied inside each
map task before the shuffle (or, optionally, values are first collapsed to
(group, value, count) by a map-side combined aggregate).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(col: str, ascending: bool) -> Column:
    c = F.col(col)
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def rank_over(df: DataFrame, partition_cols: Sequence[str], order_col: str,
              ascending: bool = True, rank_col: str = "rank") -> DataFrame:
    """Min-rank of ``order_col`` within each partition; NULL values get a NULL rank.

    Use on tables whose groups are bounded (a day-of-year across years,
    monthly totals across years); for top-N over big groups use
    ``top_n_with_ties``.
    """
    w = Window.partitionBy(*partition_cols).orderBy(_order(order_col, ascending))
    return df.withColumn(rank_col, F.when(F.col(order_col).isNotNull(), F.rank().over(w)))


def average_rank_floor(df: DataFrame, partition_cols: Sequence[str], order_col: str,
                       ascending: bool = True, rank_col: str = "rank") -> DataFrame:
    """pandas ``rank(method='average')`` truncated to int (Q12):
    ``floor(min_rank + (ties - 1) / 2)``."""
    w = Window.partitionBy(*partition_cols).orderBy(_order(order_col, ascending))
    wt = Window.partitionBy(*partition_cols, order_col)
    r = F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0
    return df.withColumn(rank_col, F.when(F.col(order_col).isNotNull(), F.floor(r).cast("int")))


def doy_rank(df: DataFrame, value_col: str, ascending: bool, keys: Sequence[str] = ("station",),
             doy_col: str = "day_of_year", rank_col: str | None = None) -> DataFrame:
    """Rank of a day's value among the same day-of-year in other years.

    The window is partitioned by (station, day_of_year): each group holds at
    most one row per year, whatever the size of the table.
    """
    name = rank_col or f"{value_col}_doy_rank"
    return rank_over(df, [*keys, doy_col], value_col, ascending, name)


def top_n_with_ties(df: DataFrame, partition_cols: Sequence[str], order_col: str, n: int,
                    ascending: bool = False, rank_col: str = "rank", method: str = "window") -> DataFrame:
    """Rows whose min-rank within their partition is ≤ n (O3, W3, W5).  All
    tied rows are kept; nothing is sampled or capped.

    ``method="window"`` (default): ``rank()`` filtered at ``≤ n``.  Catalyst
    turns this into ``WindowGroupLimit``: a partial limit inside every map
    task *before* the shuffle and a final one after it, so even a group
    holding a third of the table sends at most (n + ties) rows per map task
    to the final sort.  Global rankings (no partition) work the same way.
    The input is read once.

    ``method="distinct"``: collapse to distinct (partition, value) with counts
    (partial hash aggregation, no sort of the facts), rank the n best
    distinct values per partition, and join the ranked values back to the
    rows.  Reads the input twice; useful when the input is a cheap scan with
    very many duplicate values, or an ``n`` above
    ``spark.sql.optimizer.windowGroupLimitThreshold``.  Both methods return
    the columns of ``df`` and the rank.
    """
    part = list(partition_cols)
    v = F.col(order_col)
    rows = df.filter(v.isNotNull())
    order = _order(order_col, ascending)
    if method == "window":
        w = Window.partitionBy(*part).orderBy(order) if part else Window.orderBy(order)
        return rows.withColumn(rank_col, F.rank().over(w)).filter(F.col(rank_col) <= n)
    counts = rows.groupBy(*part, order_col).agg(F.count(F.lit(1)).alias("_ties"))
    if part:
        w = Window.partitionBy(*part).orderBy(order)
        best = counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
        wr = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    else:
        best = counts.orderBy(order).limit(n)
        wr = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # ≤ n rows
    ranked = (best.withColumn(rank_col, (F.coalesce(F.sum("_ties").over(wr), F.lit(0)) + 1).cast("int"))
              .filter(F.col(rank_col) <= n)
              .select(*part, order_col, rank_col))
    return rows.join(ranked, [*part, order_col]).select(*rows.columns, rank_col)


def top_k(df: DataFrame, order_col: str, k: int, ascending: bool = False,
          tie_break: Sequence[str] = ()) -> DataFrame:
    """O2: k rows with the largest / smallest value (``TakeOrderedAndProject``)."""
    order = [_order(order_col, ascending)] + [F.col(c).asc() for c in tie_break]
    return df.filter(F.col(order_col).isNotNull()).orderBy(*order).limit(k)


def head_with_rank(df: DataFrame, order_col: str, n: int, ascending: bool = True,
                   tie_break: str = "date", rank_col: str = "rank",
                   partition_cols: Sequence[str] = ()) -> DataFrame:
    """First n rows after sorting (ties cut, ``tie_break`` decides), with
    their min-rank among the kept rows.  Per partition when given."""
    order = [_order(order_col, ascending), F.col(tie_break).asc()]
    part = list(partition_cols)
    rows = df.filter(F.col(order_col).isNotNull())
    if part:
        w = Window.partitionBy(*part).orderBy(*order)
        kept = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    else:
        kept = rows.orderBy(*order).limit(n)
    wr = Window.partitionBy(*part).orderBy(_order(order_col, ascending))
    return kept.withColumn(rank_col, F.rank().over(wr))
