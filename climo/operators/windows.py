"""Sequence windows: gaps, streaks, rolling means, deviations.

Windows that run along a station's whole history (previous wet day, runs of
equal state, trailing 365-row means) are never evaluated as one window per
station: a station may hold a large share of all rows.  Rows are cut into
calendar segments (station, year) — bounded by the calendar, ≤ 366 daily
rows — and each window runs per segment; what crosses a segment boundary
(the last event date, the last state, island and row-count offsets) comes
from small per-segment tables (one row per station-year) combined with a
window over segments and joined back.  The trailing mean is the difference of
prefix sums inside blocks of ``rows`` rows.  Rows with a NULL key or date have
no place in a sequence and are left out; ``assert_unique_key`` rejects them at
ingest.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SEGMENT_WIDTH = 4096   # rows per segment for numeric order keys


def _segment(df: DataFrame, order_col: str) -> Column:
    """Calendar year for date / timestamp order keys, fixed-width blocks of the
    value for numeric ones."""
    c = F.col(order_col)
    dtype = dict(df.dtypes)[order_col]
    if dtype.startswith("date") or dtype.startswith("timestamp"):
        return F.year(c)
    return F.floor(c / SEGMENT_WIDTH)


def with_row_index(df: DataFrame, keys: Sequence[str], order_col: str, idx_col: str = "_idx",
                   seg_col: str = "_seg") -> DataFrame:
    """Global 1-based row position per key in ``order_col`` order, computed per
    (key, year) segment plus the row count of the key's earlier segments."""
    k = list(keys)
    d = df.withColumn(seg_col, _segment(df, order_col))
    counts = d.groupBy(*k, seg_col).agg(F.count(F.lit(1)).alias("_n"))
    wseg = Window.partitionBy(*k).orderBy(seg_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wseg), F.lit(0))).drop("_n")
    w = Window.partitionBy(*k, seg_col).orderBy(order_col)
    return (d.join(offsets, [*k, seg_col])
            .withColumn(idx_col, F.col("_off") + F.row_number().over(w)).drop("_off"))


def gap_since_previous(df: DataFrame, event, keys: Sequence[str] = ("station",),
                       date_col: str = "date", out_col: str = "dry_days") -> DataFrame:
    """For each event day (e.g. wet day) the number of days since the
    previous event day minus one (days between, Q19)."""
    k = list(keys)
    ev = df.filter(event).withColumn("_seg", _segment(df, date_col))
    w = Window.partitionBy(*k, "_seg").orderBy(date_col)
    last = ev.groupBy(*k, "_seg").agg(F.max(date_col).alias("_last"))
    carry = (last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*k).orderBy("_seg")))
             .drop("_last"))
    prev = F.coalesce(F.lag(date_col).over(w), F.col("_carry"))
    return (ev.join(carry, [*k, "_seg"])
            .withColumn(out_col, F.datediff(F.col(date_col), prev) - 1)
            .drop("_seg", "_carry"))


def state_streaks(df: DataFrame, state, keys: Sequence[str] = ("station",),
                  order_col: str = "date", state_col: str = "state") -> DataFrame:
    """Gaps-and-islands over consecutive *rows* (Q19) of equal state.

    Adds ``streak_id`` (island number per station, 1-based) and
    ``streak_len`` (running position inside the island, 1-based).

    Two passes over the rows, both windows per (station, year) segment:
    the first yields each segment's summary (rows, first / last state,
    internal state changes, position of the last change); a window over the
    small segment table turns those into carries (rows and islands before the
    segment, the island still open at its start); the second pass adds the
    carries to the segment-local running counts."""
    k = list(keys)
    base = df.withColumn(state_col, state).withColumn("_seg", _segment(df, order_col))
    w = Window.partitionBy(*k, "_seg").orderBy(order_col)
    loc = (base.withColumn("_rn", F.row_number().over(w))
           .withColumn("_ichg", F.when(F.col("_rn") == 1, 0)
                       .when(F.lag(state_col).over(w).eqNullSafe(F.col(state_col)), 0).otherwise(1)))
    seg = (loc.groupBy(*k, "_seg")
           .agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.col(state_col), F.col("_rn")).alias("_first"),
                F.max_by(F.col(state_col), F.col("_rn")).alias("_last"), F.sum("_ichg").alias("_nchg"),
                F.max(F.when(F.col("_ichg") == 1, F.col("_rn"))).alias("_lastchg")))
    ws = Window.partitionBy(*k).orderBy("_seg")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumns({
        "_off": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_bchg": F.when(F.lag("_seg").over(ws).isNull(), 1)
                  .when(F.lag("_last").over(ws).eqNullSafe(F.col("_first")), 0).otherwise(1)})
    seg = seg.withColumns({
        "_coff": F.coalesce(F.sum(F.col("_bchg") + F.col("_nchg")).over(before), F.lit(0)),
        "_own_open": F.when(F.col("_nchg") > 0, F.col("_off") + F.col("_lastchg"))
                      .when(F.col("_bchg") == 1, F.col("_off") + 1)})
    seg = seg.withColumn("_carry_open", F.last("_own_open", ignorenulls=True).over(before))
    carries = seg.select(*k, "_seg", "_off", "_bchg", "_coff", "_carry_open")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = loc.join(carries, [*k, "_seg"])
    last_chg = F.max(F.when(F.col("_ichg") == 1, F.col("_rn"))).over(run)
    start = (F.when(last_chg.isNotNull(), F.col("_off") + last_chg)
             .when(F.col("_bchg") == 1, F.col("_off") + 1).otherwise(F.col("_carry_open")))
    out = out.withColumns({
        "streak_id": (F.col("_coff") + F.col("_bchg") + F.sum("_ichg").over(run)).cast("long"),
        "_start": start})
    return (out.withColumn("streak_len", (F.col("_off") + F.col("_rn") - F.col("_start") + 1).cast("int"))
            .drop("_seg", "_rn", "_ichg", "_off", "_bchg", "_coff", "_carry_open", "_start"))


def streak_summary(streaks: DataFrame, keys: Sequence[str] = ("station",), state_col: str = "state",
                   order_col: str = "date") -> DataFrame:
    """One row per island: state, start, end and length (a plain aggregate)."""
    return (streaks.groupBy(*keys, "streak_id", state_col)
            .agg(F.min(order_col).alias("start"), F.max(order_col).alias("end"),
                 F.count(F.lit(1)).alias("length")))


def rolling_mean(df: DataFrame, value_col: str, rows: int = 365, min_periods: int = 180,
                 keys: Sequence[str] = ("station",), order_col: str = "date",
                 out_col: str | None = None) -> DataFrame:
    """Trailing mean over ``rows`` rows, NULL until ``min_periods``
    non-NULL values are in the frame.

    Rows get a global index per key and lie in blocks of ``rows`` rows.  The frame of a row at place o of a block is the
    block's prefix up to o and what the previous block has behind o: its total minus its own prefix at place o.  That
    prefix is met by a window over the rows of one place (one row per block), so no row is copied, and sums are only
    subtracted within a block.  Rows with a NULL key or order value have no place in the sequence and are left out
    (``assert_unique_key`` rejects them at ingest)."""
    k = list(keys)
    out = out_col or f"{value_col}_rolling"
    d = with_row_index(df, k, order_col).drop("_seg")
    place = (F.col("_idx") - 1) % rows
    d = d.withColumns({"_b": F.floor((F.col("_idx") - 1) / rows), "_o": place})
    block = Window.partitionBy(*k, "_b")
    upto = block.orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.col(value_col).cast("double")
    d = d.withColumns({"_s": F.coalesce(F.sum(value).over(upto), F.lit(0.0)), "_c": F.count(value).over(upto)})
    whole = block.orderBy("_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"_st": F.last("_s").over(whole) - F.col("_s"), "_ct": F.last("_c").over(whole) - F.col("_c")})
    same_place = Window.partitionBy(*k, "_o").orderBy("_b")
    total = F.col("_s") + F.coalesce(F.lag("_st").over(same_place), F.lit(0.0))
    count = F.col("_c") + F.coalesce(F.lag("_ct").over(same_place), F.lit(0))
    return d.withColumn(out, F.when((count >= min_periods) & (count > 0), total / count)).drop("_idx", "_b", "_o", "_s", "_c", "_st", "_ct")


def deviation_from_group_mean(df: DataFrame, value_col: str, group_cols: Sequence[str],
                              out_col: str = "avg_deviation") -> DataFrame:
    """Value minus the mean of its group (on an already aggregated frame)."""
    return df.withColumn(out_col, F.col(value_col) - F.avg(value_col).over(Window.partitionBy(*group_cols)))


def share_of_total(df: DataFrame, value_col: str, group_cols: Sequence[str] = (),
                   out_col: str = "share") -> DataFrame:
    """Value / group total (on an aggregated frame)."""
    return df.withColumn(out_col, F.col(value_col) / F.sum(value_col).over(Window.partitionBy(*group_cols)))


def argmax_row(df: DataFrame, group_cols: Sequence[str], value_col: str, cols: Sequence[str],
               largest: bool = True, tie_col: str | None = None) -> DataFrame:
    """The row with the largest (smallest) value per group via
    ``max_by``/``min_by`` on a struct — one aggregate, no sort."""
    key = F.struct(F.col(value_col), *([F.negative(F.col(tie_col))] if (tie_col and largest) else
                                       ([F.col(tie_col)] if tie_col else [])))
    pick = F.max_by if largest else F.min_by
    payload = F.struct(*[F.col(c) for c in cols])
    return (df.filter(F.col(value_col).isNotNull()).groupBy(*group_cols)
            .agg(pick(payload, key).alias("_r")).select(*group_cols, "_r.*"))
