"""Compound view queries (V1-V33): each dashboard callback's data step as a
parameterised DataFrame query over persisted tables (no web server)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climo.functions import calendar as cal
from climo.operators import aggregates as agg
from climo.operators import normals, ranks, reshape


def monthly_precip_rank(silver: DataFrame, keys: Sequence[str] = ("station",),
                        ascending: bool = True, n_years: int = 30,
                        year_types: Sequence[str] = cal.YEAR_TYPES) -> DataFrame:
    """Monthly and yearly (12-month) totals per calendar, ranked within
    (calendar, metric, month) — partial last month excluded."""
    monthly = normals.monthly_totals_long(silver, keys, mode="trailing", n_years=n_years, year_types=year_types)
    both = agg.with_year_rows(monthly, keys, ["year_type", "metric_name", "year_for_dash"], "total", "sum")
    return ranks.rank_over(both, [*keys, "year_type", "metric_name", "month"], "total", ascending, "rank")


def monthly_temp_rank(daily: DataFrame, keys: Sequence[str] = ("station",),
                      metrics: Sequence[str] = ("max_temp", "min_temp", "avg_temp")) -> DataFrame:
    """V4: monthly means and yearly mean-of-means per metric, ranked
    (ascending) within (month, metric) — partial last month excluded."""
    d = reshape.exclude_partial_month(daily, keys)
    monthly = agg.monthly_means(d, metrics, keys)
    both = agg.with_year_rows(monthly, keys, ["year", "metric"], "mean", "avg")
    return ranks.rank_over(both, [*keys, "month", "metric"], "mean", True, "rank")


def hourly_season_deviation(hourly: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("station",)) -> DataFrame:
    """V6/V7: season × hour means (cascade of unweighted means) and each hour's
    deviation from its season mean."""
    from climo.operators import windows
    season = agg.hourly_cascade(hourly, metrics, keys)[2]
    return windows.deviation_from_group_mean(season, "metric_value", [*keys, "season", "metric_name"])


# ---- fixed values ---------------------------------------------------------
SNOW_BIN_EDGES = [0, 1, 3, 5, 8, 12, 18]
SNOW_BIN_LABELS = ["0in", "0-1in", "1-3in", "3-5in", "5-8in", "8-12in", "12-18in", "18+in"]
RAIN_BIN_EDGES = [0, 0.25, 0.5, 0.75, 1, 2]
RAIN_BIN_LABELS = ["0in", "0-0.25in", "0.25-0.5in", "0.5-0.75in", "0.75-1in", "1-2in", "2+in"]
CLOUD_BIN_WIDTH = 10.0
# ---------------------------------------------------------------------------


def doy_key(col: str = "day_of_year"):
    """Integer join key for the fractional day index (59.5 → 119)."""
    return (F.col(col) * 2).cast("int")


def normals_from_doy_means(daily: DataFrame, years: tuple, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Daily normals table (station, day_of_year, normal_high/low/temp) as plain
    day-of-year means over a window of years (A6) — the unsmoothed variant of
    the spline normals."""
    d = daily.withColumn("day_of_year", cal.doy_index("date"))
    m = normals.doy_means(d, ["max_temp", "min_temp", "avg_temp"], keys, year_range=years)
    return m.withColumnsRenamed({"max_temp": "normal_high", "min_temp": "normal_low", "avg_temp": "normal_temp"})


def join_normals(daily: DataFrame, daily_normals: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Facts ⟕ daily normals on (station, day of year), joined on the integer
    key 2·doy.  The normals side is one row per station-day-of-year; AQE
    broadcasts it when its measured size allows, else sort-merge."""
    d = daily.withColumn("day_of_year", cal.doy_index("date")).withColumn("_dk", doy_key())
    n = daily_normals.withColumn("_dk", doy_key()).drop("day_of_year")
    return d.join(n, [*keys, "_dk"], "left").drop("_dk")


def departures(joined: DataFrame) -> DataFrame:
    """F16: departure of high / low / mean from the normals."""
    from climo.functions import derive as dv
    return joined.withColumns({
        "departure_high": dv.departure("max_temp", "normal_high"),
        "departure_low": dv.departure("min_temp", "normal_low"),
        "departure_mean": dv.departure("avg_temp", "normal_temp")})


def departure_month_mean(daily: DataFrame, daily_normals: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Mean daily departure per (year, month)."""
    d = departures(join_normals(daily, daily_normals, keys))
    return (d.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month_num"))
            .agg(F.avg("departure_high").alias("departure_high"), F.avg("departure_low").alias("departure_low"),
                 F.avg("departure_mean").alias("departure_mean")))


def temp_band_window(daily: DataFrame, daily_normals: DataFrame, start_year: int,
                     keys: Sequence[str] = ("station",)) -> DataFrame:
    """V1: five years of days with their normals, day-of-year ranks over all
    years and flags: record high / low (rank 1) and the window's coldest high
    / warmest low (largest rank inside the window)."""
    from pyspark.sql import Window
    d = join_normals(daily, daily_normals, keys)
    d = ranks.doy_rank(d, "max_temp", ascending=False, keys=keys, rank_col="high_rank")
    d = ranks.doy_rank(d, "min_temp", ascending=True, keys=keys, rank_col="low_rank")
    d = d.filter(F.year("date").between(start_year, start_year + 4))
    w = Window.partitionBy(*keys)
    return d.select(*keys, "date", "max_temp", "min_temp", "normal_high", "normal_low", "high_rank", "low_rank",
                    (F.col("high_rank") == 1).alias("record_high"), (F.col("low_rank") == 1).alias("record_low"),
                    (F.col("low_rank") == F.max("low_rank").over(w)).alias("warmest_low"),
                    (F.col("high_rank") == F.max("high_rank").over(w)).alias("coldest_high"))


def calendar_departure(daily: DataFrame, daily_normals: DataFrame, metric: str, start_year: int,
                       keys: Sequence[str] = ("station",)) -> DataFrame:
    """V3: daily departure of one metric from normal over a five-year window."""
    normal_of = {"max_temp": "normal_high", "min_temp": "normal_low", "avg_temp": "normal_temp"}[metric]
    d = join_normals(daily.filter(F.year("date").between(start_year, start_year + 4)), daily_normals, keys)
    return d.select(*keys, "date", F.col(metric).alias("value"), (F.col(metric) - F.col(normal_of)).alias("departure"))


def observed_vs_normal(silver: DataFrame, monthly_normals: DataFrame, keys: Sequence[str] = ("station",),
                       metric: str | None = None, current_year_only: bool = False) -> DataFrame:
    """Calendar-year monthly totals next to the monthly normal, long form
    (type observed / normal).  Inner join on (month, metric) drops metrics
    without a normal (precip_day, Q17).  ``metric`` picks one metric,
    ``current_year_only`` each station's latest year, as the dashboard shows."""
    if current_year_only:
        latest = reshape.per_key_scalars(silver, keys, _current=F.max("year"))
        silver = reshape.attach_scalars(silver, latest, keys).filter(F.col("year") == F.col("_current")).drop("_current")
    totals = normals.monthly_totals_long(silver, keys, mode="trailing", complete_months_only=False,
                                         year_types=["calendar_year"]).drop("year_type")
    norm_long = (monthly_normals.withColumnsRenamed({"norm_precip": "precip", "norm_snow": "snow",
                                                     "norm_rain": "rain", "norm_precip_perc": "precip_perc"})
                 .unpivot([*keys, "month"], ["precip", "snow", "rain", "precip_perc"], "metric_name", "normal"))
    if metric is not None:
        totals = totals.filter(F.col("metric_name") == metric)
    j = totals.withColumnRenamed("total", "observed").join(norm_long, [*keys, "month", "metric_name"], "inner")
    return j.unpivot([*keys, "metric_name", "month", "year_for_dash"], ["observed", "normal"], "type", "metric_value")


def on_this_day(df: DataFrame, label: str) -> DataFrame:
    """Rows whose day index equals that of a 'Mon DD' label."""
    target = cal.doy_from_label(F.lit(label))
    d = df if "day_of_year" in df.columns else df.withColumn("day_of_year", cal.doy_index("date"))
    return d.filter(F.col("day_of_year") == target)


def on_this_day_histogram(df: DataFrame, label: str, metric: str, width: float | None, origin: float = 0.0,
                          keys: Sequence[str] = ("station",)) -> DataFrame:
    """Percent of years per value bin on one calendar day; ``width=None`` picks each key's width."""
    return agg.histogram_percent(on_this_day(df, label), metric, width, origin, keys)


def on_this_day_binned(df: DataFrame, label: str, metric: str, edges, labels,
                       keys: Sequence[str] = ("station",)) -> DataFrame:
    """Percent of years per labelled step bin (F10) on one calendar day."""
    from climo.functions import derive as dv
    d = on_this_day(df, label)
    return agg.labelled_bin_percent(d, dv.step_bin(metric, edges, labels, labels[-1], null_label="missing"), keys)


def on_this_day_trend(df: DataFrame, label: str, metrics: Sequence[str], keys: Sequence[str] = ("station",)) -> DataFrame:
    """The value of each metric on one calendar day, by year."""
    d = on_this_day(df, label)
    return d.select(*keys, F.year("date").alias("year"), *metrics)


def yearly_trend_table(daily: DataFrame, silver: DataFrame, hot: float, freeze: float,
                       keys: Sequence[str] = ("station",),
                       extra_metrics: Sequence[str] = ("cloud_cover", "pressure", "dew_point", "wind_speed")) -> DataFrame:
    """One long (metric_name, year, total, rank) table of yearly
    metrics — yearly temperature means, water-year precipitation totals,
    yearly temperature records and yearly means of other measurements —
    without each station's last (partial) year."""
    k = list(keys)
    mm = monthly_temp_rank(daily, keys).filter(F.col("month") == cal.YEAR_LABEL)
    a = mm.select(*k, F.col("metric").alias("metric_name"), F.col("year").cast("int").alias("year"),
                  F.col("mean").alias("total"), "rank")
    pr = monthly_precip_rank(silver, keys, year_types=["water_year"]).filter(F.col("month") == cal.YEAR_LABEL)
    b = pr.select(*k, "metric_name", F.col("year_for_dash").cast("int").alias("year"), "total", "rank")
    c = agg.temp_year_metrics(daily, hot, freeze, keys).select(*k, "metric_name", "year", "total", "rank")
    ym = agg.yearly_means_multi(daily, list(extra_metrics), keys)
    dl = ym.unpivot([*k, "year"], list(extra_metrics), "metric_name", "total")
    dl = ranks.rank_over(dl, [*k, "metric_name"], "total", ascending=False)
    u = a.unionByName(b).unionByName(c).unionByName(dl.select(*k, "metric_name", "year", "total", "rank"))
    # one row per (station, metric, year): a window over the station's rows of
    # this small table reads the union once
    from pyspark.sql import Window
    maxy = F.max("year").over(Window.partitionBy(*k))
    return u.withColumn("_maxy", maxy).filter(F.col("year") <= F.col("_maxy") - 1).drop("_maxy")


def yearly_departure(trend: DataFrame, metric: str, start_year: int, n_years: int = 30,
                     keys: Sequence[str] = ("station",)) -> DataFrame:
    """One metric's yearly values from ``start_year`` with the mean of
    the shown years and the departure from the mean of the last ``n_years``."""
    from pyspark.sql import Window
    k = list(keys)
    t = trend.withColumn("_maxy", F.max("year").over(Window.partitionBy(*k)))
    t = t.filter((F.col("metric_name") == metric) & (F.col("year") >= start_year))
    w = Window.partitionBy(*k)
    base = F.avg(F.when(F.col("year") >= F.col("_maxy") - n_years, F.col("total"))).over(w)
    return t.select(*k, "year", "total", F.avg("total").over(w).alias("avg_line"),
                    (F.col("total") - base).alias("departure_from_normal"))


def temps_with_bands(daily: DataFrame, years: tuple, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Daily rows ⟕ day-of-year percentile bands of highs and lows — both
    band families from one aggregate, joined once on the integer doy key."""
    d = daily.withColumn("day_of_year", cal.doy_index("date"))
    win = d.filter(F.year("date").between(*years))
    bands = (win.groupBy(*keys, "day_of_year")
             .agg(F.percentile("max_temp", [0.1, 0.9]).alias("_h"), F.percentile("min_temp", [0.1, 0.9]).alias("_l"))
             .select(*keys, doy_key().alias("_dk"), F.col("_h")[0].alias("max_temp_p10"),
                     F.col("_h")[1].alias("max_temp_p90"), F.col("_l")[0].alias("min_temp_p10"),
                     F.col("_l")[1].alias("min_temp_p90")))
    return (d.withColumn("_dk", doy_key()).join(bands, [*keys, "_dk"], "left").drop("_dk")
            .select(*keys, "date", "day_of_year", "max_temp", "min_temp", "max_temp_p10", "max_temp_p90",
                    "min_temp_p10", "min_temp_p90"))


def monthly_precip_anomaly(silver: DataFrame, monthly_normals: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """J3 + F17: monthly totals ⟕ monthly normals on month → absolute anomalies
    and percent of normal precipitation (NULL when the normal is 0)."""
    from climo.functions import derive as dv
    tot = (silver.groupBy(*keys, "year", "month")
           .agg(agg._sum0("precip").alias("precip"), agg._sum0("snow").alias("snow"), agg._sum0("rain").alias("rain")))
    j = tot.join(monthly_normals, [*keys, "month"], "left")
    return j.select(*keys, "year", "month", "precip", "snow", "rain",
                    (F.col("precip") - F.col("norm_precip")).alias("precip_anomaly"),
                    (F.col("snow") - F.col("norm_snow")).alias("snow_anomaly"),
                    (F.col("rain") - F.col("norm_rain")).alias("rain_anomaly"),
                    dv.anomaly_pct("precip", "norm_precip").alias("precip_anomaly_perc"))


def hourly_with_sun(hourly: DataFrame, sun: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """J5 + F11 (V8 inputs): hourly rows ⟕ sunrise / sunset of their day, with
    the decimal hours of sunrise and sunset."""
    h = hourly.withColumn("day", F.to_date("timestamp"))
    s = sun.withColumns({"sunrise_hr": cal.iso_to_decimal_hour("sunrise"),
                         "sunset_hr": cal.iso_to_decimal_hour("sunset")})
    return h.join(s, [*keys, "day"], "left").select(*keys, "timestamp", "day", "temp", "sunrise", "sunset",
                                                     "sunrise_hr", "sunset_hr")


def ytd_view(silver: DataFrame, year_type: str, metric: str, keys: Sequence[str] = ("station",),
             mode: str = "trailing") -> DataFrame:
    """Year-to-date running totals of one metric in one calendar for
    every year, flagged current / other, with the calendar label."""
    st = normals.precip_stacked(silver, keys, mode, year_types=[year_type])
    run = normals.running_totals_wide(st, [*keys, "year_for_dash"], ["day_of_year_dash", "date"], [metric])
    return run.select(*keys, "date", "year_for_dash", "is_current", "day_of_year_dash",
                      F.col(metric).alias("year_to_date"), F.date_format("date", "MMM dd").alias("dashboard_date"))


def ytd_chart(silver: DataFrame, ytd_normals: DataFrame, year_type: str, metric: str, keys: Sequence[str] = ("station",),
              mode: str = "trailing") -> DataFrame:
    """V10 in full: every year's running totals with the normals line at the same day index, and the month ticks.

    ``normal_ytd`` is the average of the normals table (A10) and ``month_tick`` its calendar label on the first of each
    month (NULL on other days and where the table has no such day)."""
    line = ytd_normals.where((F.col("year_type") == year_type) & (F.col("metric_name") == metric))
    first = F.when(F.col("dashboard_date").endswith("01"), F.col("dashboard_date"))
    line = line.select(*keys, doy_key("day_of_year_dash").alias("_dk"), F.col("avg_precip_ytd").alias("normal_ytd"), first.alias("month_tick"))
    years = ytd_view(silver, year_type, metric, keys, mode).withColumn("_dk", doy_key("day_of_year_dash"))
    return years.join(line, [*keys, "_dk"], "left").drop("_dk")


def mtd_view(silver: DataFrame, metric: str, keys: Sequence[str] = ("station",), mode: str = "trailing") -> DataFrame:
    """The current (latest) month's running total of one metric per
    station next to the month-to-date normals of that month (NULL bands
    dropped)."""
    st = (normals.precip_stacked(silver, keys, mode, year_types=["calendar_year"])
          .withColumn("day_of_month", F.dayofmonth("date")))
    cur = st.filter(F.col("is_current") & (F.trunc("date", "MM") == F.trunc("key_max_date", "MM")))
    run = normals.running_totals_wide(cur, [*keys, "month"], ["date"], [metric])
    nrm = normals.mtd_normals(silver, keys, mode, metrics=[metric]).dropna()
    return (run.select(*keys, "month", "day_of_month", F.col(metric).alias("month_to_date"))
            .join(nrm.drop("metric_name"), [*keys, "month", "day_of_month"], "inner"))


def hourly_density(hourly: DataFrame, x: str, y: str, months: Sequence[str], x_range: tuple, y_range: tuple,
                   n_years: int = 30, exclude_last_year: bool = True, bins: int = 100,
                   keys: Sequence[str] = ("station",)) -> DataFrame:
    """V9: 2-D density (plus marginals) of two hourly metrics over the selected
    months and the ``n_years`` years before each station's latest year (or
    ending with it when ``exclude_last_year`` is False)."""
    h = hourly.withColumns({"_y": F.year("timestamp"), "_m": cal.month_label("timestamp")})
    last = reshape.per_key_scalars(h, keys, _last=F.max("_y") - (1 if exclude_last_year else 0))
    h = (reshape.attach_scalars(h, last, keys)
         .filter(F.col("_y").between(F.col("_last") - (n_years - 1), F.col("_last")) & F.col("_m").isin(list(months))))
    return agg.density_2d(h, x, y, x_range, y_range, bins, bins, keys)


def sun_lines(sun: DataFrame, year: int, keys: Sequence[str] = ("station",)) -> DataFrame:
    """V8 overlay: sunrise / sunset of one year as decimal hours by day index."""
    s = sun.filter(F.year("day") == year)
    return s.select(*keys, cal.doy_index("day").alias("day_of_year"),
                    cal.iso_to_decimal_hour("sunrise").alias("sunrise_hr"),
                    cal.iso_to_decimal_hour("sunset").alias("sunset_hr"))
