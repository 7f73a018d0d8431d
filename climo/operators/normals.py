"""Climatological normals.

All normals are two-level aggregates: facts are reduced per (station,
year, period) with partial + final hash aggregation, and the second level
works on the much smaller per-year table.  Percentiles are exact
(``percentile`` = linear interpolation, like numpy); ``percentile_approx`` is
offered as an opt-in for very wide groups.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climo.functions import calendar as cal
from climo.operators import accumulate, reshape

# ---- fixed values ---------------------------------------------------------
BAND_PERCENTILES = [0.1, 0.25, 0.5, 0.75, 0.9]
PRECIP_METRICS = ["precip", "snow", "rain", "precip_day"]
# ---------------------------------------------------------------------------


def percentiles(col: str | Column, probs: Sequence[float], exact: bool = True,
                accuracy: int = 10000) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if exact:
        return F.percentile(c, list(probs))
    return F.percentile_approx(c, list(probs), accuracy)


def order_statistic(values: Column, p: float) -> Column:
    """The p-quantile (linear interpolation) of an ascending array without nulls; NULL if it is empty."""
    last = F.size(values) - 1
    at = last * F.lit(float(p))
    below = F.floor(at).cast("int")
    low, high = F.get(values, below), F.get(values, F.least(below + 1, last))
    return F.when(last >= 0, low + (high - low) * (at - below))


def _sum0(c) -> Column:
    """pandas-style sum: all-NULL group sums to 0 (Q3)."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def precip_monthly_normals(silver: DataFrame, keys: Sequence[str] = ("station",),
                           n_years: int = 30) -> DataFrame:
    """A5: monthly normals over the trailing window [Y-n, Y-1] of each station:
    monthly sums (and wet-day share) per year, then the mean per month."""
    sc = reshape.per_key_scalars(silver, keys, _cy=F.max("year"))
    inwin = (reshape.attach_scalars(silver, sc, keys)
             .filter(F.col("year").between(F.col("_cy") - n_years, F.col("_cy") - 1)))
    monthly = (inwin.groupBy(*keys, "year", "month")
               .agg(_sum0("precip").alias("precip"), _sum0("snow").alias("snow"),
                    _sum0("rain").alias("rain"), F.avg("precip_day").alias("precip_day")))
    return (monthly.groupBy(*keys, "month")
            .agg(F.avg("precip").alias("norm_precip"), F.avg("snow").alias("norm_snow"),
                 F.avg("rain").alias("norm_rain"), F.avg("precip_day").alias("norm_precip_perc")))


def doy_means(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("station",),
              doy_col: str = "day_of_year", year_range: tuple | None = None) -> DataFrame:
    """Mean of each metric by day of year (optionally inside a year window)."""
    if year_range is not None:
        df = df.filter(F.year("date").between(*year_range))
    return df.groupBy(*keys, doy_col).agg(*[F.avg(m).alias(m) for m in metrics])


def doy_percentile_bands(df: DataFrame, metric: str, probs: Sequence[float] = (0.1, 0.9),
                         keys: Sequence[str] = ("station",), doy_col: str = "day_of_year",
                         year_range: tuple | None = None, exact: bool = True) -> DataFrame:
    """Percentile bands of a metric by day of year; one column per band
    (``<metric>_p10`` …), all bands from one aggregate."""
    if year_range is not None:
        df = df.filter(F.year("date").between(*year_range))
    agg = df.groupBy(*keys, doy_col).agg(percentiles(metric, probs, exact).alias("_p"))
    return agg.select(*keys, doy_col, *[F.col("_p")[i].alias(f"{metric}_p{int(round(p * 100))}")
                                        for i, p in enumerate(probs)])


def _metric_double(m: str):
    return F.col(m).cast("double")


def running_totals_wide(stacked: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
                        metrics: Sequence[str]) -> DataFrame:
    """W7/W8 on the wide rows: one window computes the running total of every
    metric (NULL counts as 0), so the sort runs once per row instead of once
    per (row, metric)."""
    from pyspark.sql import Window
    w = (Window.partitionBy(*partition_cols).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stacked.withColumns({m: F.sum(F.coalesce(_metric_double(m), F.lit(0.0))).over(w) for m in metrics})


def _wide_stats_then_melt(rows: DataFrame, group_cols: Sequence[str], metrics: Sequence[str], value_prefix: str,
                          suffix: str, probs: Sequence[float], exact: bool = True) -> DataFrame:
    """Per group and metric: mean and percentiles over normals-window years, min and max over all years.

    A group holds at most one row per year, so its rows are gathered once (all metrics in one array) and each metric's
    order statistics are read off its sorted values.  ``exact=False`` aggregates percentile sketches instead, for groups
    without that bound."""
    stat_names = ["avg", "min", "max"] + [f"p{int(round(p * 100))}" for p in probs]

    def melted(wide: DataFrame, fields_of) -> DataFrame:
        per_metric = [F.struct(F.lit(m).alias("metric_name"), *[f.alias(f"{n}_{value_prefix}_{suffix}") for f, n in zip(fields_of(m), stat_names)])
                      for m in metrics]
        return wide.select(*group_cols, F.explode(F.array(*per_metric)).alias("_m")).select(*group_cols, "_m.*")

    if not exact:
        aggs = []
        for m in metrics:
            nv = F.when(F.col("norm_range"), F.col(m))
            aggs += [F.avg(nv).alias(f"{m}__avg"), F.min(m).alias(f"{m}__min"), F.max(m).alias(f"{m}__max"),
                     percentiles(nv, probs, False).alias(f"{m}__p")]
        return melted(rows.groupBy(*group_cols).agg(*aggs),
                      lambda m: [F.col(f"{m}__avg"), F.col(f"{m}__min"), F.col(f"{m}__max"), *[F.col(f"{m}__p")[i] for i in range(len(probs))]])
    gathered = rows.groupBy(*group_cols).agg(F.collect_list(F.struct("norm_range", *metrics)).alias("_rows"))
    def values(m: str, of: Column) -> Column:
        return F.filter(F.transform(of, lambda r: r[m]), lambda v: v.isNotNull())

    past = F.filter("_rows", lambda r: r["norm_range"])
    arrays = {f"{m}__all": values(m, F.col("_rows")) for m in metrics}
    arrays.update({f"{m}__norm": F.sort_array(values(m, past)) for m in metrics})
    wide = gathered.select(*group_cols, *[v.alias(k) for k, v in arrays.items()])

    def fields(m: str) -> list[Column]:
        norm, every = F.col(f"{m}__norm"), F.col(f"{m}__all")
        mean = F.when(F.size(norm) > 0, F.aggregate(norm, F.lit(0.0), lambda a, x: a + x) / F.size(norm))
        return [mean, F.array_min(every), F.array_max(every), *[order_statistic(norm, p) for p in probs]]

    return melted(wide, fields)


def mtd_normals(silver: DataFrame, keys: Sequence[str] = ("station",), mode: str = "decade",
                n_years: int = 30, metrics: Sequence[str] = PRECIP_METRICS,
                probs: Sequence[float] = BAND_PERCENTILES, exact: bool = True) -> DataFrame:
    """Month-to-date normals by (metric, month, day of month).

    Mean and percentiles use only years inside the normals window; min and
    max use every past year (Q10).  The current year is excluded.
    """
    cal_rows = (reshape.stack_calendars(silver, keys, mode=mode, n_years=n_years, year_types=["calendar_year"])
                .withColumn("day_of_month", F.dayofmonth("date")))
    run = running_totals_wide(cal_rows, [*keys, "year_for_dash", "month"], ["date"], metrics)
    past = run.filter(~F.col("is_current"))
    out = _wide_stats_then_melt(past, [*keys, "month", "day_of_month"], metrics, "precip", "mtd", probs, exact)
    return out.select(*keys, "metric_name", "month", "day_of_month", "avg_precip_mtd",
                      "min_precip_mtd", "max_precip_mtd",
                      *[f"p{int(round(p * 100))}_precip_mtd" for p in probs])


LONG_IDS = ["date", "month", "day_of_year", "year_type", "year_num", "year_for_dash",
            "current_year", "is_current", "norm_range", "day_of_year_dash"]


def precip_stacked(silver: DataFrame, keys: Sequence[str] = ("station",), mode: str = "decade",
                   n_years: int = 30, complete_months_only: bool = False,
                   year_types: Sequence[str] = cal.YEAR_TYPES) -> DataFrame:
    """Silver rows stacked by calendar (wide: one column per metric).

    ``complete_months_only`` drops each station's partial last month (P8)."""
    stacked = reshape.stack_calendars(silver, keys, mode=mode, n_years=n_years, year_types=year_types)
    if complete_months_only:
        stacked = reshape.exclude_partial_month(stacked, keys)
    return stacked


def precip_long(silver: DataFrame, keys: Sequence[str] = ("station",), mode: str = "decade",
                n_years: int = 30, metrics: Sequence[str] = PRECIP_METRICS,
                complete_months_only: bool = False) -> DataFrame:
    """Silver rows stacked by calendar and melted to (metric_name, metric_value)."""
    stacked = precip_stacked(silver, keys, mode, n_years, complete_months_only)
    return reshape.unpivot_metrics(stacked, [*keys, *LONG_IDS], metrics)


def monthly_totals_long(silver: DataFrame, keys: Sequence[str] = ("station",), mode: str = "trailing",
                        n_years: int = 30, metrics: Sequence[str] = PRECIP_METRICS,
                        complete_months_only: bool = True,
                        year_types: Sequence[str] | None = None) -> DataFrame:
    """A1: (keys, year_type, metric_name, year_for_dash, month, total).

    Calendars start with a month, so the facts are summed once per (key, year, month), wide; the small monthly table is then
    stacked by calendar and melted.  ``mode`` and ``n_years`` only matter for flags that the totals don't have."""
    types = list(year_types) if year_types is not None else list(cal.YEAR_TYPES)
    rows = reshape.exclude_partial_month(silver, keys) if complete_months_only else silver
    monthly = (rows.groupBy(*keys, F.trunc("date", "MM").alias("_first"), "month")
               .agg(*[_sum0(_metric_double(m)).alias(m) for m in metrics]))
    labels = {"calendar_year": F.year("_first").cast("string"), "water_year": cal.water_year(F.col("_first")).cast("string"),
              "snow_season": cal.season_label(cal.season_start(F.col("_first")))}
    entries = F.array(*[F.struct(F.lit(t).alias("year_type"), labels[t].alias("year_for_dash")) for t in types])
    stacked = monthly.select(*keys, "month", *metrics, F.explode(entries).alias("_cal"))
    wide = stacked.select(*keys, "_cal.year_type", "_cal.year_for_dash", "month", *metrics)
    return reshape.unpivot_metrics(wide, [*keys, "year_type", "year_for_dash", "month"], metrics,
                                   "metric_name", "total")


def incomplete_years(stacked: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """(station, calendar, year) whose first day index is not 1 (Q11: only
    a missing start counts as incomplete)."""
    return (stacked.groupBy(*keys, "year_type", "year_for_dash")
            .agg(F.min("day_of_year_dash").alias("min_index"))
            .filter(F.col("min_index") != 1).drop("min_index"))


def ytd_normals(silver: DataFrame, keys: Sequence[str] = ("station",), mode: str = "decade",
                n_years: int = 30, metrics: Sequence[str] = PRECIP_METRICS,
                probs: Sequence[float] = BAND_PERCENTILES, exact: bool = True) -> DataFrame:
    """A10: year-to-date normals by (calendar, metric, day index); incomplete
    years removed (A11, J7), the leap-day bucket dropped (P13) and a calendar
    label added (F3)."""
    from pyspark.sql import Window
    st = precip_stacked(silver, keys, mode, n_years)
    part = [*keys, "year_type", "year_for_dash"]
    run = running_totals_wide(st, part, ["day_of_year_dash", "date"], metrics)
    # Drop years whose first index is not 1 — the year's minimum
    # index comes from the same window partition as the running totals, so
    # the stacked rows are read once (no anti-join against a second pass)
    first_index = F.min("day_of_year_dash").over(Window.partitionBy(*part))
    kept = (run.withColumn("_first", first_index)
            .filter((F.col("_first") == 1) & ~F.col("is_current") & (F.col("day_of_year") % 1 == 0)))
    out = _wide_stats_then_melt(kept, [*keys, "year_type", "day_of_year", "day_of_year_dash"], metrics,
                                "precip", "ytd", probs, exact)
    return out.select(*keys, "year_type", "metric_name", "day_of_year", "day_of_year_dash",
                      "avg_precip_ytd", "min_precip_ytd", "max_precip_ytd",
                      *[f"p{int(round(p * 100))}_precip_ytd" for p in probs],
                      cal.doy_label("day_of_year").alias("dashboard_date"))


def normal_month_means(daily_normals: DataFrame, cols: Sequence[str],
                       keys: Sequence[str] = ("station",), month_col: str = "month") -> DataFrame:
    """Monthly mean of daily normal curves, rounded half-even to 1 dp."""
    return daily_normals.groupBy(*keys, month_col).agg(
        *[F.bround(F.avg(c), 1).alias(c) for c in cols])
