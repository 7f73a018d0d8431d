"""Grouped summaries.

Every aggregate is a hash aggregate keyed by (station, …): partial
aggregation runs before the shuffle, so a hot station or month costs one
partial row per map task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climo.functions import calendar as cal
from climo.operators import ranks, reshape

# ---- fixed values ---------------------------------------------------------
EVENT_QUANTILES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
HOURLY_METRICS = ["temp", "humidity", "wind_speed", "dew_point", "precip_chance",
                  "precip", "rain", "snow", "cloud_cover", "pressure"]
# ---------------------------------------------------------------------------


def _sum0(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


# ---- monthly / yearly totals and means ------------------------------------

def monthly_totals(long_df: DataFrame, keys: Sequence[str] = ("station",),
                   by: Sequence[str] = ("year_type", "metric_name", "year_for_dash", "month")) -> DataFrame:
    """A1: sum of the metric per month (all-NULL month sums to 0, Q3)."""
    return long_df.groupBy(*keys, *by).agg(_sum0("metric_value").alias("total"))


def yearly_totals(monthly: DataFrame, keys: Sequence[str] = ("station",),
                  by: Sequence[str] = ("year_type", "metric_name", "year_for_dash"),
                  value_col: str = "total") -> DataFrame:
    """A2: sum of monthly totals for years with all 12 months, labelled month 'Year'."""
    return (monthly.groupBy(*keys, *by)
            .agg(F.sum(value_col).alias(value_col), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == 12).drop("_n")
            .withColumn("month", F.lit(cal.YEAR_LABEL)))


def with_year_rows(monthly: DataFrame, keys: Sequence[str], by: Sequence[str], value_col: str,
                   how: str = "sum") -> DataFrame:
    """U2 + A2/A4 in one aggregate: the monthly rows plus one 'Year' row per
    (keys, by) for years with all 12 months (sum or mean of the months).

    Grouping sets over the (small) monthly table replace a union of two
    aggregates, so the monthly table is computed and read once."""
    k, b = list(keys), list(by)
    fn = F.sum if how == "sum" else F.avg
    g = (monthly.groupingSets([[*k, *b, "month"], [*k, *b]], *k, *b, "month")
         .agg(fn(value_col).alias(value_col), F.count(value_col).alias("_n"), F.grouping("month").alias("_g")))
    return (g.filter((F.col("_g") == 0) | (F.col("_n") == 12))
            .withColumn("month", F.when(F.col("_g") == 1, F.lit(cal.YEAR_LABEL)).otherwise(F.col("month")))
            .drop("_n", "_g"))


def monthly_means(daily: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("station",)) -> DataFrame:
    """A3: mean of each metric per (year, month), long form (metric, mean);
    aggregated on the wide rows, melted afterwards."""
    wide = (daily.groupBy(*keys, F.year("date").alias("year"), cal.month_label("date").alias("month"))
            .agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics]))
    return reshape.unpivot_metrics(wide, [*keys, "year", "month"], metrics, "metric", "mean")


def yearly_means(monthly: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """A4: mean of the monthly means (Q18: not re-weighted by days) for years
    with 12 months, labelled month 'Year'."""
    return (monthly.groupBy(*keys, "year", "metric")
            .agg(F.avg("mean").alias("mean"), F.count("mean").alias("_n"))
            .filter(F.col("_n") == 12).drop("_n")
            .withColumn("month", F.lit(cal.YEAR_LABEL)))


def month_climate_summary(daily: DataFrame, keys: Sequence[str] = ("station",),
                          normal_years: tuple | None = None, dp: int | None = 1) -> DataFrame:
    """Per calendar month — mean high / low / average over the normals
    years, p90 of highs and p10 of lows, record high / low and the date each
    record was set (earliest date on ties, Q16)."""
    y = F.year("date")
    in_win = y.between(*normal_years) if normal_years else F.lit(True)
    rnd = (lambda c: F.bround(c, dp)) if dp is not None else (lambda c: c)
    return (daily.withColumn("month", cal.month_label("date"))
            .groupBy(*keys, "month")
            .agg(rnd(F.avg(F.when(in_win, F.col("max_temp")))).alias("normal_high"),
                 rnd(F.avg(F.when(in_win, F.col("min_temp")))).alias("normal_low"),
                 rnd(F.avg(F.when(in_win, F.col("avg_temp")))).alias("normal_temp"),
                 rnd(F.percentile("max_temp", 0.9)).alias("max_temp_p90"),
                 rnd(F.percentile("min_temp", 0.1)).alias("min_temp_p10"),
                 F.max("max_temp").alias("record_high"),
                 F.min("min_temp").alias("record_low"),
                 F.max_by("date", F.struct(F.col("max_temp"), F.negative(F.unix_date("date"))))
                 .alias("record_high_date"),
                 F.min_by("date", F.struct(F.col("min_temp"), F.unix_date("date"))).alias("record_low_date")))


def yearly_extremes(daily: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Per year the max high and min low with the (first) date of each."""
    return (daily.groupBy(*keys, F.year("date").alias("year"))
            .agg(F.max("max_temp").alias("max_high"),
                 F.max_by("date", F.struct(F.col("max_temp"), F.negative(F.unix_date("date")))).alias("max_high_date"),
                 F.min("min_temp").alias("min_low"),
                 F.min_by("date", F.struct(F.col("min_temp"), F.unix_date("date"))).alias("min_low_date")))


def monthly_extremes(daily: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Max high and min low per calendar month."""
    return (daily.groupBy(*keys, F.month("date").alias("month_num"))
            .agg(F.max("max_temp").alias("max_high"), F.min("min_temp").alias("min_low")))


def threshold_day_counts(daily: DataFrame, hot: float, cold: float, freeze: float,
                         keys: Sequence[str] = ("station",)) -> DataFrame:
    """Days with high ≥ hot, low < cold, low ≤ freeze, per year."""
    return (daily.groupBy(*keys, F.year("date").alias("year"))
            .agg(F.count_if(F.col("max_temp") >= hot).alias("hot_days"),
                 F.count_if(F.col("min_temp") < cold).alias("cold_days"),
                 F.count_if(F.col("min_temp") <= freeze).alias("freeze_days")))


def yearly_means_multi(daily: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("station",)) -> DataFrame:
    """Yearly mean of several metrics."""
    return daily.groupBy(*keys, F.year("date").alias("year")).agg(*[F.avg(m).alias(m) for m in metrics])


def temp_year_metrics(daily: DataFrame, hot: float, freeze: float,
                      keys: Sequence[str] = ("station",)) -> DataFrame:
    """Yearly max, min, hot-day and frost-day counts, mean diurnal range;
    long form ranked (desc) per metric *before* the partial last year is
    dropped (as the reference does)."""
    yearly = (daily.groupBy(*keys, F.year("date").alias("year"))
              .agg(F.max("max_temp").cast("double").alias("full_max"),
                   F.min("min_temp").cast("double").alias("full_min"),
                   F.count_if(F.col("max_temp") >= hot).cast("double").alias("days_100"),
                   F.count_if(F.col("min_temp") <= freeze).cast("double").alias("frost_days"),
                   F.avg(F.col("max_temp") - F.col("min_temp")).alias("diurnal_temp_range")))
    long = yearly.unpivot([*keys, "year"], ["full_max", "full_min", "days_100", "frost_days",
                                            "diurnal_temp_range"], "metric_name", "total")
    ranked = ranks.rank_over(long, [*keys, "metric_name"], "total", ascending=False)
    # the yearly table has a row for every year with data, so its max year is
    # the station's last (partial) year; a window over this small table
    from pyspark.sql import Window
    maxy = F.max("year").over(Window.partitionBy(*keys, "metric_name"))
    return ranked.withColumn("_maxy", maxy).filter(F.col("year") < F.col("_maxy")).drop("_maxy")


def frost_dates(daily: DataFrame, freeze: float, keys: Sequence[str] = ("station",),
                split_doy: float = 200.0) -> DataFrame:
    """Per year the last frost day index before ``split_doy`` and the first
    after it; NULL when there is none."""
    frost = F.col("min_temp") <= freeze
    doy = cal.doy_index("date")
    return (daily.groupBy(*keys, F.year("date").alias("year"))
            .agg(F.max(F.when(frost & (doy < split_doy), doy)).alias("last_frost"),
                 F.min(F.when(frost & (doy > split_doy), doy)).alias("first_frost")))


def season_event_dates(daily: DataFrame, event: Column, keys: Sequence[str] = ("station",),
                       prefix: str = "freeze", date_col: str = "date") -> DataFrame:
    """Per snow season the first and last event day index and the
    first event date, restricted to complete seasons of each station
    (the season after the first observed Aug 1 … the last ending by July)."""
    d = F.col(date_col)
    rows = daily.filter(event).withColumns({
        "snow_season": cal.season_label(cal.season_start(d)),
        "season_start": cal.season_start(d),
        "snow_day_of_year": cal.doy_index(d, "snow_season")})
    agg = (rows.groupBy(*keys, "snow_season", "season_start")
           .agg(F.min("snow_day_of_year").alias(f"first_{prefix}_doy"),
                F.min(date_col).alias(f"first_{prefix}_date"),
                F.max("snow_day_of_year").alias(f"last_{prefix}_doy")))
    bounds = complete_season_bounds(daily, keys, date_col)
    return (reshape.attach_scalars(agg, bounds, keys)
            .filter((F.col("season_start") >= F.col("min_season")) & (F.col("season_start") < F.col("max_season")))
            .drop("min_season", "max_season"))


def complete_season_bounds(daily: DataFrame, keys: Sequence[str] = ("station",),
                           date_col: str = "date") -> DataFrame:
    """First and last season start years fully covered by each station."""
    lo, hi = F.min(date_col), F.max(date_col)
    return reshape.per_key_scalars(
        daily, keys,
        min_season=F.when(F.month(lo) >= 8, F.year(lo) + 1).otherwise(F.year(lo)),
        max_season=F.when(F.month(hi) < 7, F.year(hi) - 1).otherwise(F.year(hi)))


def event_date_percentiles(events: DataFrame, doy_col: str, metric: str,
                           keys: Sequence[str] = ("station",),
                           probs: Sequence[float] = EVENT_QUANTILES) -> DataFrame:
    """Quantiles of a season day index → calendar label and 'Nth Percentile'."""
    q = events.groupBy(*keys).agg(F.percentile(doy_col, list(probs)).alias("_q"))
    labels = F.array(*[F.lit(f"{int(p * 100)}th Percentile") for p in probs])
    ex = q.select(*keys, F.posexplode("_q").alias("_i", "season_doy"))
    return ex.select(*keys, F.lit(metric).alias("metric"), labels[F.col("_i")].alias("percentile"),
                     "season_doy", cal.doy_label(cal.season_doy_to_calendar("season_doy")).alias("date"))


def season_snow_summary(silver: DataFrame, keys: Sequence[str] = ("station",),
                        start_month: int = 9) -> DataFrame:
    """Per season (Sep-start variant) total snow, first and last snow day,
    ranked by total with pandas average ties truncated to int (Q12)."""
    d = F.col("date")
    s = cal.season_start(d, start_month)
    agg = (silver.withColumn("season_year", s)
           .groupBy(*keys, "season_year")
           .agg(_sum0("snow").alias("total_snow"),
                F.min(F.when(F.col("snow") > 0, d)).alias("first_snow"),
                F.max(F.when(F.col("snow") > 0, d)).alias("last_snow")))
    return ranks.average_rank_floor(agg, keys, "total_snow", ascending=False, rank_col="snow_rank")


# ---- hourly ---------------------------------------------------------------

def hourly_attributes(hourly: DataFrame) -> DataFrame:
    t = F.col("timestamp")
    return hourly.withColumns({
        "hour": F.hour(t), "year": F.year(t), "month": cal.month_label(t), "month_num": F.month(t),
        "day_of_year": cal.doy_index(F.to_date(t)),
        "precip_chance": F.when(F.col("precip") > 0, 1.0).otherwise(0.0),
        "season": cal.season_of_month(F.month(t))})


def hourly_means(hourly: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("station",),
                 by_season: bool = False) -> DataFrame:
    """Mean of each metric by hour (and season)."""
    h = hourly_attributes(hourly)
    by = [*keys, "hour"] + (["season"] if by_season else [])
    return h.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def _hourly_means_long(hourly: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of every metric per group, aggregated on the wide rows and melted
    afterwards (7× fewer rows through the shuffle than melting first; ``avg``
    skips NULLs per metric either way)."""
    h = hourly_attributes(hourly)
    wide = h.groupBy(*by).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    return reshape.unpivot_metrics(wide, list(by), metrics, "metric_name", "metric_value")


def hourly_cascade(hourly: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("station",)):
    """(month, year) means → mean over years per month → mean over
    months per season (unweighted means of means).  Returns the three frames."""
    month_year = _hourly_means_long(hourly, metrics, [*keys, "year", "month", "month_num", "hour"])
    month = (month_year.groupBy(*keys, "month", "month_num", "hour", "metric_name")
             .agg(F.avg("metric_value").alias("metric_value"))
             .withColumn("season", cal.season_of_month(F.col("month_num"))))
    season = (month.groupBy(*keys, "season", "hour", "metric_name")
              .agg(F.avg("metric_value").alias("metric_value")))
    return month_year, month, season


def hourly_heatmap(hourly: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("station",),
                   drop_leap_day: bool = False) -> DataFrame:
    """Mean by (day of year, hour, metric) with the calendar label;
    ``drop_leap_day`` leaves out index 59.5 (Feb 29), as the dashboard does."""
    if drop_leap_day:
        hourly = hourly.filter((F.month("timestamp") != 2) | (F.dayofmonth("timestamp") != 29))
    return (_hourly_means_long(hourly, metrics, [*keys, "day_of_year", "hour"])
            .withColumn("doy_label", cal.doy_label("day_of_year")))


def hourly_year_summary(hourly: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Min / max temperature, precipitation and snow totals, mean cloud cover per year."""
    return (hourly.groupBy(*keys, F.year("timestamp").alias("year"))
            .agg(F.min("temp").alias("min_temp"), F.max("temp").alias("max_temp"),
                 _sum0("precip").alias("total_precip"), _sum0("snow").alias("total_snow"),
                 F.avg("cloud_cover").alias("cloud_cover_avg")))


# ---- distributions --------------------------------------------------------

def round_width(raw: Column) -> Column:
    """The smallest of 1, 2, 5 and 10 times a power of ten that is at least ``raw`` (> 0)."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    times = raw / unit
    return unit * F.when(times <= 1, 1.0).when(times <= 2, 2.0).when(times <= 5, 5.0).otherwise(10.0)


def automatic_width(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """One bin width per key from its quartiles and count (2 IQR / cube root of n, rounded up by ``round_width``).

    Where the quartiles coincide the range is cut in about sqrt(n) bins; where all values are equal the width is 1.  Values are
    counted before the quartiles are taken, so a key costs as much as it has distinct values."""
    v = F.col(col).cast("double")
    counts = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
    stats = counts.groupBy(*keys).agg(F.percentile("_v", [0.25, 0.75], F.col("_n")).alias("_q"), F.sum("_n").alias("_n"),
                                      F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    spread, reach = F.col("_q")[1] - F.col("_q")[0], F.col("_hi") - F.col("_lo")
    raw = F.when(spread > 0, 2.0 * spread / F.cbrt(F.col("_n"))).when(reach > 0, reach / F.ceil(F.sqrt("_n")))
    return stats.select(*keys, F.coalesce(round_width(raw), F.lit(1.0)).alias("bin_width"))


def histogram_percent(df: DataFrame, col: str, width: float | None, origin: float = 0.0,
                      keys: Sequence[str] = ()) -> DataFrame:
    """Share (percent) of non-NULL rows per bin ``[lo, lo+w)`` of one width for all, or, with ``width=None``, of each
    key's automatic width (``bin_width`` is a column then)."""
    from pyspark.sql import Window
    rows, step, more = df.filter(F.col(col).isNotNull()), F.lit(width), []
    if width is None:
        widths = automatic_width(df, col, keys)
        widths = widths if keys else F.broadcast(widths.withColumn("_one", F.lit(1)))
        rows = reshape.attach_scalars(rows, widths, keys)
        step, more = F.col("bin_width"), ["bin_width"]
    b = F.floor((F.col(col) - origin) / step)
    counts = rows.groupBy(*keys, *more, (b * step + origin).alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(w))


def labelled_bin_percent(df: DataFrame, label_col: Column, keys: Sequence[str] = ()) -> DataFrame:
    """A30 for categorical bins (step bins F10): percent of rows per label."""
    from pyspark.sql import Window
    counts = df.groupBy(*keys, label_col.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys)))


def bucket(x, lo: float, hi: float, n: int) -> Column:
    """Equal-width bucket 1..n of [lo, hi); 0 below, n+1 at or above ``hi``."""
    v = F.col(x) if isinstance(x, str) else x
    w = (hi - lo) / n
    return (F.when(v < lo, F.lit(0)).when(v >= hi, F.lit(n + 1))
            .otherwise(F.floor((v - lo) / w).cast("int") + 1)).cast("long")


def density_2d(df: DataFrame, x: str, y: str, x_range: tuple, y_range: tuple,
               nx: int = 100, ny: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """2-D histogram on an nx × ny grid plus both marginals.

    Rows are first reduced to cells (partial + final aggregation); the
    marginals are grouping sets over the cell table, so the facts are read
    and shuffled once.  ``level``: 0 = cell, 1 = x marginal, 2 = y marginal.
    """
    binned = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
              .select(*keys, bucket(x, *x_range, nx).alias("x_bin"), bucket(y, *y_range, ny).alias("y_bin")))
    cells = binned.groupBy(*keys, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))
    k = list(keys)
    sets = [[*k, "x_bin", "y_bin"], [*k, "x_bin"], [*k, "y_bin"]]
    return (cells.groupingSets([[F.col(c) for c in s_] for s_ in sets], *k, "x_bin", "y_bin")
            .agg(F.sum("n").alias("n"),
                 (F.grouping("x_bin") * 2 + F.grouping("y_bin")).cast("int").alias("level")))


def grouped_avg(df: DataFrame, category: str, measure: str) -> DataFrame:
    """Mean of a measure per category."""
    return df.groupBy(category).agg(F.avg(measure).alias(f"avg_{measure}"))


def wind_rose(wind: DataFrame, keys: Sequence[str] = ("station",), months: Sequence[str] | None = None) -> DataFrame:
    """Count by (month, speed bin, 16-point direction); rolled up over the
    selected months with each combination's share of the total (W14)."""
    from climo.functions import derive as dv
    binned = (wind.withColumns({"month": cal.month_label("date"),
                             "wind_speed_cat": dv.wind_speed_bin("wind_speed"),
                             "wind_direction_cat": dv.compass_sector("wind_direction")})
              .filter(F.col("wind_speed_cat").isNotNull() & F.col("wind_direction_cat").isNotNull()))
    if months is not None:
        binned = binned.filter(F.col("month").isin(list(months)))
    counts = (binned.groupBy(*keys, "wind_speed_cat", "wind_direction_cat")
              .agg(F.count(F.lit(1)).alias("frequency")))
    from climo.operators import windows
    return windows.share_of_total(counts, "frequency", keys)


def record_day_counts(daily: DataFrame, metric: str, keys: Sequence[str] = ("station",),
                      positive_only: bool = False) -> DataFrame:
    """Per year, how many days set the day-of-year record high (rank 1
    descending) and record low (rank 1 ascending, counted negative)."""
    d = daily.withColumn("day_of_year", cal.doy_index("date"))
    d = ranks.doy_rank(d, metric, ascending=False, keys=keys, rank_col="_hi")
    d = ranks.doy_rank(d, metric, ascending=True, keys=keys, rank_col="_lo")
    if positive_only:
        d = d.filter(F.col(metric) > 0)
    return (d.groupBy(*keys, F.year("date").alias("year"))
            .agg(F.count_if(F.col("_hi") == 1).alias("record_highs"),
                 (-F.count_if(F.col("_lo") == 1)).alias("record_lows")))
