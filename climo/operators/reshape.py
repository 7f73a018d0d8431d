"""Reshaping: calendar stacking, unpivot / pivot, category completion."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climo.functions import calendar as cal


def per_key_scalars(df: DataFrame, keys: Sequence[str], **aggs) -> DataFrame:
    """One row of scalars (max year, max date, …) per key.

    The result has one row per station; it is joined back on the key (AQE
    broadcasts it when its measured size allows).  With no keys it is a
    single row (keyed by a constant) and is broadcast explicitly.
    """
    if keys:
        return df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    return F.broadcast(df.agg(*[v.alias(k) for k, v in aggs.items()]).withColumn("_one", F.lit(1)))


def attach_scalars(df: DataFrame, scalars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join of per-key scalars back onto the rows (no cross join: the
    key-less case joins the single scalar row on a constant)."""
    if keys:
        return df.join(scalars, list(keys))
    return df.withColumn("_one", F.lit(1)).join(scalars, "_one").drop("_one")


def last_complete_month_end(max_date) -> "F.Column":
    """The last day of the latest complete month."""
    m = F.col(max_date) if isinstance(max_date, str) else max_date
    return F.when(m == F.last_day(m), m).otherwise(F.date_sub(F.trunc(m, "MM"), 1))


def exclude_partial_month(df: DataFrame, keys: Sequence[str] = ("station",),
                          date_col: str = "date") -> DataFrame:
    """Keep rows up to the end of each key's last complete month.

    Uses the key's latest date when the frame already carries it
    (``key_max_date``, added by ``stack_calendars``); otherwise computes it
    with a per-key aggregate joined back on the key."""
    if "key_max_date" in df.columns:
        return df.filter(F.col(date_col) <= last_complete_month_end("key_max_date"))
    sc = per_key_scalars(df, keys, _max_date=F.max(date_col))
    return (attach_scalars(df, sc, keys)
            .filter(F.col(date_col) <= last_complete_month_end("_max_date")).drop("_max_date"))


def normal_ranges(mode: str, n_years: int = 30):
    """Return a function (max_year, max_water_year, max_season_start) → dict of
    (lo, hi) Column bounds per calendar, following the two conventions (Q9):

    * ``decade``   — normals job: window ending at the last complete decade of
      the latest calendar / water year; the snow-season window is the
      calendar window shifted to end relative to the latest season.
    * ``trailing`` — dashboard: ``[max - n, max]`` for calendar and water year,
      ``[max - n + 1, max - 1]`` seasons.
    """
    def decade(cy, wy, ss):
        lo, hi = cal.normal_window(cy, n_years, True)
        wlo, whi = cal.normal_window(wy, n_years, True)
        return {"calendar_year": (lo, hi), "water_year": (wlo, whi),
                "snow_season": (ss - (cy - lo), ss - (cy - hi))}

    def trailing(cy, wy, ss):
        return {"calendar_year": (cy - n_years, cy), "water_year": (wy - n_years, wy),
                "snow_season": (ss - n_years + 1, ss - 1)}

    return {"decade": decade, "trailing": trailing}[mode]


def stack_calendars(df: DataFrame, keys: Sequence[str] = ("station",), date_col: str = "date",
                    mode: str = "decade", n_years: int = 30,
                    year_types: Sequence[str] = cal.YEAR_TYPES) -> DataFrame:
    """Each daily row once per calendar (calendar year, water year, snow
    season — or the subset in ``year_types``) in a single scan (``explode``
    of an array of structs).

    Adds ``year_type``, ``year_num`` (calendar year / water year / season
    start), ``year_for_dash`` (label), ``current_year`` (label of the key's
    latest year of that calendar), ``norm_range`` and ``day_of_year_dash``.
    """
    d = F.col(date_col)
    base = df.withColumns({
        "_y": F.year(d), "_wy": cal.water_year(d), "_ss": cal.season_start(d)})
    sc = per_key_scalars(base, keys, _cy=F.max("_y"), _cwy=F.max("_wy"), _css=F.max("_ss"),
                         key_max_date=F.max(date_col))
    base = attach_scalars(base, sc, keys)
    rng = normal_ranges(mode, n_years)(F.col("_cy"), F.col("_cwy"), F.col("_css"))

    def entry(yt, num, label, cur_label, cur_num):
        lo, hi = rng[yt]
        return F.struct(F.lit(yt).alias("year_type"), num.cast("int").alias("year_num"),
                        label.alias("year_for_dash"), cur_label.alias("current_year"),
                        (cur_num == num).alias("is_current"),
                        num.between(lo, hi).alias("norm_range"),
                        cal.doy_index(d, yt).alias("day_of_year_dash"))

    entries = {
        "calendar_year": lambda: entry("calendar_year", F.col("_y"), F.col("_y").cast("string"),
                                       F.col("_cy").cast("string"), F.col("_cy")),
        "water_year": lambda: entry("water_year", F.col("_wy"), F.col("_wy").cast("string"),
                                    F.col("_cwy").cast("string"), F.col("_cwy")),
        "snow_season": lambda: entry("snow_season", F.col("_ss"), cal.season_label(F.col("_ss")),
                                     cal.season_label(F.col("_css")), F.col("_css")),
    }
    # only the requested calendars are generated (a filter after the explode
    # cannot prune array elements)
    arr = F.array(*[entries[yt]() for yt in year_types])
    return (base.withColumn("_cal", F.explode(arr))
            .select(*[c for c in df.columns], "key_max_date", "_cal.*"))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str],
                    name_col: str = "metric_name", value_col: str = "metric_value") -> DataFrame:
    """Wide → long (melt); values cast to double.

    Exploded structs, for they keep the partitioning of the rows, which ``unpivot`` forgets."""
    entries = [F.struct(F.lit(m).alias(name_col), F.col(m).cast("double").alias(value_col)) for m in metrics]
    return df.select(*ids, F.explode(F.array(*entries)).alias("_m")).select(*ids, "_m.*")


def pivot_years(df: DataFrame, row_col: str, pivot_col: str, value_col: str,
                values: Sequence | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """R2: long → year × month matrix (``first`` of the value per cell)."""
    g = df.groupBy(*keys, row_col)
    p = g.pivot(pivot_col, list(values)) if values is not None else g.pivot(pivot_col)
    return p.agg(F.first(value_col))


def complete_categories(df: DataFrame, keys: Sequence[str], dims: dict, fill: dict) -> DataFrame:
    """Every combination of fixed dimension values per key (categorical
    ``observed=False``), missing combinations filled.

    ``dims`` maps a column to its (small, fixed) list of values.  The grid is
    built per key by exploding the literal lists — ∏|dims| rows per key, no
    cross join of data — and left-joined with the observed rows."""
    k = list(keys)
    grid = df.select(*k).distinct()
    for col, values in dims.items():
        grid = grid.withColumn(col, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.join(df, [*k, *dims.keys()], "left").fillna(fill)


def fill_daily_spine(df: DataFrame, keys: Sequence[str] = ("station",), date_col: str = "date",
                     fill: dict | None = None) -> DataFrame:
    """One row per key and day between the key's first and last date; days
    without an observation get ``fill`` values (e.g. 0 precipitation)."""
    bounds = df.groupBy(*keys).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    spine = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(date_col))
    out = spine.join(df, [*keys, date_col], "left")
    return out.fillna(fill) if fill else out
