"""Registered queries: each is (spark, sf_dir) -> DataFrame over the test
tables, with a DuckDB oracle SQL twin where the semantics are SQL-expressible.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from climo.functions import calendar as cal
from climo.operators import ranks
from climo.sources import fixtures as fx
from climo.sources.fixtures import doy_sql, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    if sql is not None:
        ORACLE[name] = sql

    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------
# Day-of-year records (flagship)

def doy_record_highs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose high is the highest (or low the lowest) of all years on the
    same day of year, per station."""
    t = fx.daily_temps(spark, sf_dir).withColumn("day_of_year", cal.doy_index("date"))
    t = ranks.doy_rank(t, "max_temp", ascending=False, rank_col="high_rank")
    t = ranks.doy_rank(t, "min_temp", ascending=True, rank_col="low_rank")
    return (t.filter((F.col("high_rank") == 1) | (F.col("low_rank") == 1))
            .select("station", "date", "day_of_year", "max_temp", "min_temp", "high_rank", "low_rank"))


register("doy_record_highs", with_fixtures("daily_temps") + f"""
, t AS (SELECT *, {doy_sql('date')} AS day_of_year FROM daily_temps),
r AS (SELECT *,
    CAST(rank() OVER (PARTITION BY station, day_of_year ORDER BY max_temp DESC NULLS LAST) AS INTEGER) AS high_rank,
    CAST(rank() OVER (PARTITION BY station, day_of_year ORDER BY min_temp ASC NULLS LAST) AS INTEGER) AS low_rank
  FROM t)
SELECT station, date, day_of_year, max_temp, min_temp, high_rank, low_rank
FROM r WHERE high_rank = 1 OR low_rank = 1""")(doy_record_highs)


# ---------------------------------------------------------------------------
# SQL helpers shared by the oracle twins

def _stack_sql(mode: str = "decade", src: str = "silver") -> str:
    """DuckDB twin of reshape.stack_calendars + precip_long (CTEs sc, stk, long)."""
    if mode == "decade":
        cal_lo, cal_hi = "(floor(cy / 10) * 10 - 29)", "(floor(cy / 10) * 10)"
        wat_lo, wat_hi = "(floor(cwy / 10) * 10 - 29)", "(floor(cwy / 10) * 10)"
        sn_lo, sn_hi = f"(css - (cy - {cal_lo}))", f"(css - (cy - {cal_hi}))"
    else:
        cal_lo, cal_hi, wat_lo, wat_hi = "(cy - 30)", "cy", "(cwy - 30)", "cwy"
        sn_lo, sn_hi = "(css - 29)", "(css - 1)"
    base = f"SELECT s.*, sc.cy, sc.cwy, sc.css FROM {src} s JOIN sc USING (station)"
    return f"""
, sc AS (SELECT station, max(year) AS cy, max(water_year) AS cwy, max(season_start) AS css FROM {src} GROUP BY station),
b AS ({base}),
stk AS (
  SELECT *, 'calendar_year' AS year_type, year AS year_num, CAST(year AS VARCHAR) AS year_for_dash,
         CAST(cy AS VARCHAR) AS current_year, year = cy AS is_current,
         year BETWEEN {cal_lo} AND {cal_hi} AS norm_range, {doy_sql('date')} AS day_of_year_dash FROM b
  UNION ALL
  SELECT *, 'water_year', water_year, CAST(water_year AS VARCHAR), CAST(cwy AS VARCHAR), water_year = cwy,
         water_year BETWEEN {wat_lo} AND {wat_hi}, {doy_sql('date', 92)} FROM b
  UNION ALL
  SELECT *, 'snow_season', season_start, snow_season, CAST(css AS VARCHAR) || '-' || CAST(css + 1 AS VARCHAR),
         season_start = css, season_start BETWEEN {sn_lo} AND {sn_hi}, {doy_sql('date', 153)} FROM b),
long AS (
  SELECT *, 'precip' AS metric_name, CAST(precip AS DOUBLE) AS metric_value FROM stk
  UNION ALL SELECT *, 'snow', CAST(snow AS DOUBLE) FROM stk
  UNION ALL SELECT *, 'rain', CAST(rain AS DOUBLE) FROM stk
  UNION ALL SELECT *, 'precip_day', CAST(precip_day AS DOUBLE) FROM stk)"""


def _pct_cols(expr: str, suffix: str, probs=(0.1, 0.25, 0.5, 0.75, 0.9)) -> str:
    return ", ".join(f"quantile_cont({expr}, {p}) AS p{int(round(p * 100))}_{suffix}" for p in probs)


def _last_month_end(d: str) -> str:
    return (f"(CASE WHEN {d} = last_day({d}) THEN {d} "
            f"ELSE CAST(date_trunc('month', {d}) - INTERVAL 1 DAY AS DATE) END)")


# ---------------------------------------------------------------------------
# Silver table

@register("precip_silver", with_fixtures("precip_silver") + "\nSELECT * FROM silver")
def q_precip_silver(spark, sf_dir):
    """Raw daily precipitation → silver table with calendar attributes and rain/snow split."""
    from climo.sources.ingest import build_precip_silver
    return build_precip_silver(fx.daily_precip_raw(spark, sf_dir))


@register("calendar_indexes", f"""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
x AS (SELECT date, {doy_sql('date')} AS doy_calendar, {doy_sql('date', 92)} AS doy_water,
             {doy_sql('date', 153)} AS doy_snow FROM d),
y AS (SELECT *, CASE WHEN doy_calendar = 59.5 THEN 'Feb 29'
                ELSE strftime(DATE '2025-01-01' + CAST(floor(doy_calendar) - 1 AS INTEGER), '%b %d') END AS doy_label,
             CAST(floor(((doy_snow - 154) % 365.0 + 365.0) % 365.0 + 1) AS INTEGER) AS snow_to_calendar
      FROM x)
SELECT *, {doy_sql("CAST(strptime(doy_label || ' 2024', '%b %d %Y') AS DATE)")} AS label_roundtrip FROM y""")
def q_calendar_indexes(spark, sf_dir):
    """F1 (three calendars), F3 label, F4 season→calendar, F23 label→index round trip."""
    d = (spark.read.parquet(f"{sf_dir}/orders.parquet")
         .select(F.to_date("o_orderdate").alias("date")).distinct())
    x = d.select("date", cal.doy_index("date").alias("doy_calendar"),
                 cal.doy_index("date", "water_year").alias("doy_water"),
                 cal.doy_index("date", "snow_season").alias("doy_snow"))
    x = x.withColumns({"doy_label": cal.doy_label("doy_calendar"),
                       "snow_to_calendar": cal.season_doy_to_calendar("doy_snow")})
    return x.withColumn("label_roundtrip", cal.doy_from_label("doy_label"))


# ---------------------------------------------------------------------------
# A5: monthly precipitation normals

@register("precip_monthly_normals", with_fixtures("precip_silver") + """
, cy AS (SELECT station, max(year) AS cy FROM silver GROUP BY station),
m AS (SELECT s.station, s.year, s.month, coalesce(sum(precip), 0.0) AS precip, coalesce(sum(snow), 0.0) AS snow,
             coalesce(sum(rain), 0.0) AS rain, avg(precip_day) AS precip_day
      FROM silver s JOIN cy USING (station) WHERE s.year BETWEEN cy.cy - 30 AND cy.cy - 1 GROUP BY 1, 2, 3)
SELECT station, month, avg(precip) AS norm_precip, avg(snow) AS norm_snow, avg(rain) AS norm_rain,
       avg(precip_day) AS norm_precip_perc FROM m GROUP BY 1, 2""")
def q_precip_monthly_normals(spark, sf_dir):
    """A5: per station and month, the mean over the trailing 30 years of monthly precipitation, snow
    and rain totals and of the wet-day share."""
    from climo.operators import normals
    return normals.precip_monthly_normals(fx.precip_silver(spark, sf_dir))


# ---------------------------------------------------------------------------
# V12 = A1 + A2 + W2 (+ P8, U1, R1, U2): monthly precipitation rank

@register("monthly_precip_rank", with_fixtures("precip_silver") + _stack_sql("trailing") + f"""
, mx AS (SELECT station, max(date) AS mx FROM silver GROUP BY station),
lm AS (SELECT l.* FROM long l JOIN mx USING (station) WHERE l.date <= {_last_month_end('mx.mx')}),
mt AS (SELECT station, year_type, metric_name, year_for_dash, month, coalesce(sum(metric_value), 0.0) AS total
       FROM lm GROUP BY ALL),
yt AS (SELECT station, year_type, metric_name, year_for_dash, 'Year' AS month, sum(total) AS total
       FROM mt GROUP BY station, year_type, metric_name, year_for_dash HAVING count(*) = 12),
u AS (SELECT * FROM mt UNION ALL SELECT * FROM yt)
SELECT *, CAST(rank() OVER (PARTITION BY station, year_type, metric_name, month ORDER BY total ASC) AS INTEGER) AS rank
FROM u""")
def q_monthly_precip_rank(spark, sf_dir):
    """V12 (A1 + A2 + W2): monthly and 12-month totals per calendar and metric, ranked (ascending)
    within calendar × metric × month; partial last month excluded."""
    from climo.plans import views
    return views.monthly_precip_rank(fx.precip_silver(spark, sf_dir))


# ---------------------------------------------------------------------------
# Month-to-date normals

@register("mtd_normals", with_fixtures("precip_silver") + _stack_sql("decade") + f"""
, c AS (SELECT *, dayofmonth(date) AS day_of_month,
          sum(coalesce(metric_value, 0.0)) OVER (PARTITION BY station, metric_name, year_for_dash, month
                                         ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mtd
        FROM long WHERE year_type = 'calendar_year')
SELECT station, metric_name, month, CAST(day_of_month AS INTEGER) AS day_of_month,
       avg(CASE WHEN norm_range THEN mtd END) AS avg_precip_mtd, min(mtd) AS min_precip_mtd,
       max(mtd) AS max_precip_mtd, {_pct_cols('CASE WHEN norm_range THEN mtd END', 'precip_mtd')}
FROM c WHERE NOT is_current GROUP BY 1, 2, 3, 4""")
def q_mtd_normals(spark, sf_dir):
    """A9 (W7): month-to-date precipitation normals by metric, month and day of month."""
    from climo.operators import normals
    return normals.mtd_normals(fx.precip_silver(spark, sf_dir))


# Year-to-date normals

@register("ytd_normals", with_fixtures("precip_silver") + _stack_sql("decade") + f"""
, c AS (SELECT *, sum(coalesce(metric_value, 0.0)) OVER (PARTITION BY station, year_type, metric_name, year_for_dash
                   ORDER BY day_of_year_dash, date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ytd FROM long),
bad AS (SELECT station, year_type, year_for_dash FROM long GROUP BY ALL HAVING min(day_of_year_dash) <> 1),
k AS (SELECT c.* FROM c ANTI JOIN bad USING (station, year_type, year_for_dash) WHERE NOT is_current)
SELECT station, year_type, metric_name, day_of_year, day_of_year_dash,
       avg(CASE WHEN norm_range THEN ytd END) AS avg_precip_ytd, min(ytd) AS min_precip_ytd, max(ytd) AS max_precip_ytd,
       {_pct_cols('CASE WHEN norm_range THEN ytd END', 'precip_ytd')},
       CASE WHEN day_of_year = 59.5 THEN 'Feb 29'
            ELSE strftime(DATE '2025-01-01' + CAST(floor(day_of_year) - 1 AS INTEGER), '%b %d') END AS dashboard_date
FROM k GROUP BY 1, 2, 3, 4, 5 HAVING day_of_year % 1 = 0""")
def q_ytd_normals(spark, sf_dir):
    """A10 (W8, A11, J7): year-to-date normals by calendar, metric and day index, incomplete years
    removed."""
    from climo.operators import normals
    return normals.ytd_normals(fx.precip_silver(spark, sf_dir))


# ---------------------------------------------------------------------------
# V4 = A3 + A4 + W2: monthly temperature rank

@register("monthly_temp_rank", with_fixtures("daily_temps") + f"""
, mx AS (SELECT station, max(date) AS mx FROM daily_temps GROUP BY station),
d AS (SELECT t.* FROM daily_temps t JOIN mx USING (station) WHERE t.date <= {_last_month_end('mx.mx')}),
l AS (SELECT station, CAST(year(date) AS INTEGER) AS year, strftime(date, '%b') AS month, 'max_temp' AS metric, max_temp AS temp FROM d
      UNION ALL SELECT station, CAST(year(date) AS INTEGER), strftime(date, '%b'), 'min_temp', min_temp FROM d
      UNION ALL SELECT station, CAST(year(date) AS INTEGER), strftime(date, '%b'), 'avg_temp', avg_temp FROM d),
m AS (SELECT station, year, month, metric, avg(temp) AS mean FROM l GROUP BY ALL),
y AS (SELECT station, year, 'Year' AS month, metric, avg(mean) AS mean FROM m GROUP BY station, year, metric
      HAVING count(mean) = 12),
u AS (SELECT * FROM m UNION ALL SELECT * FROM y)
SELECT *, CAST(rank() OVER (PARTITION BY station, month, metric ORDER BY mean ASC) AS INTEGER) AS rank FROM u""")
def q_monthly_temp_rank(spark, sf_dir):
    """V4 (A3 + A4 + W2): monthly means and 12-month mean-of-means of high / low / average, ranked
    within month × metric."""
    from climo.plans import views
    return views.monthly_temp_rank(fx.daily_temps(spark, sf_dir))


# ---------------------------------------------------------------------------
# Daily temperature summaries

_NORMAL_YEARS = (fx.NORMAL_START, fx.NORMAL_END)
_YR = "CAST(year(date) AS INTEGER)"


@register("month_climate_summary", with_fixtures("daily_temps") + f"""
SELECT station, strftime(date, '%b') AS month,
  avg(CASE WHEN year(date) BETWEEN {fx.NORMAL_START} AND {fx.NORMAL_END} THEN max_temp END) AS normal_high,
  avg(CASE WHEN year(date) BETWEEN {fx.NORMAL_START} AND {fx.NORMAL_END} THEN min_temp END) AS normal_low,
  avg(CASE WHEN year(date) BETWEEN {fx.NORMAL_START} AND {fx.NORMAL_END} THEN avg_temp END) AS normal_temp,
  quantile_cont(max_temp, 0.9) AS max_temp_p90, quantile_cont(min_temp, 0.1) AS min_temp_p10,
  max(max_temp) AS record_high, min(min_temp) AS record_low,
  first(date ORDER BY max_temp DESC, date ASC) AS record_high_date,
  first(date ORDER BY min_temp ASC, date ASC) AS record_low_date
FROM daily_temps GROUP BY 1, 2""")
def q_month_climate_summary(spark, sf_dir):
    """Per-month normals (window years), p90/p10 bands, records and their dates."""
    from climo.operators import aggregates as agg
    return agg.month_climate_summary(fx.daily_temps(spark, sf_dir), normal_years=_NORMAL_YEARS, dp=None)


@register("yearly_extremes", with_fixtures("daily_temps") + f"""
SELECT station, {_YR} AS year, max(max_temp) AS max_high, first(date ORDER BY max_temp DESC, date) AS max_high_date,
       min(min_temp) AS min_low, first(date ORDER BY min_temp ASC, date) AS min_low_date
FROM daily_temps GROUP BY 1, 2""")
def q_yearly_extremes(spark, sf_dir):
    """A12 (J8): per year the highest high and lowest low with the (earliest) date of each."""
    from climo.operators import aggregates as agg
    return agg.yearly_extremes(fx.daily_temps(spark, sf_dir))


@register("monthly_extremes", with_fixtures("daily_temps") + """
SELECT station, CAST(month(date) AS INTEGER) AS month_num, max(max_temp) AS max_high, min(min_temp) AS min_low
FROM daily_temps GROUP BY 1, 2""")
def q_monthly_extremes(spark, sf_dir):
    """Highest high and lowest low per calendar month."""
    from climo.operators import aggregates as agg
    return agg.monthly_extremes(fx.daily_temps(spark, sf_dir))


@register("threshold_day_counts", with_fixtures("daily_temps") + f"""
SELECT station, {_YR} AS year, CAST(count_if(max_temp >= {fx.HOT_THRESHOLD}) AS BIGINT) AS hot_days,
       CAST(count_if(min_temp < 10000.0) AS BIGINT) AS cold_days,
       CAST(count_if(min_temp <= {fx.FREEZE_THRESHOLD}) AS BIGINT) AS freeze_days
FROM daily_temps GROUP BY 1, 2""")
def q_threshold_day_counts(spark, sf_dir):
    """Per year the number of hot days, cold days and freeze days (fixture-scaled thresholds)."""
    from climo.operators import aggregates as agg
    return agg.threshold_day_counts(fx.daily_temps(spark, sf_dir), fx.HOT_THRESHOLD, 10000.0, fx.FREEZE_THRESHOLD)


@register("yearly_means_multi", with_fixtures("daily_temps") + f"""
SELECT station, {_YR} AS year, avg(dew_point) AS dew_point, avg(cloud_cover) AS cloud_cover,
       avg(pressure) AS pressure, avg(wind_speed) AS wind_speed FROM daily_temps GROUP BY 1, 2""")
def q_yearly_means_multi(spark, sf_dir):
    """Yearly means of dew point, cloud cover, pressure and wind speed."""
    from climo.operators import aggregates as agg
    return agg.yearly_means_multi(fx.daily_temps(spark, sf_dir), ["dew_point", "cloud_cover", "pressure", "wind_speed"])


@register("temp_year_metrics", with_fixtures("daily_temps") + f"""
, y AS (SELECT station, {_YR} AS year, CAST(max(max_temp) AS DOUBLE) AS full_max, CAST(min(min_temp) AS DOUBLE) AS full_min,
          CAST(count_if(max_temp >= {fx.HOT_THRESHOLD}) AS DOUBLE) AS days_100,
          CAST(count_if(min_temp <= {fx.FREEZE_THRESHOLD}) AS DOUBLE) AS frost_days,
          avg(max_temp - min_temp) AS diurnal_temp_range FROM daily_temps GROUP BY 1, 2),
l AS (SELECT station, year, 'full_max' AS metric_name, full_max AS total FROM y
      UNION ALL SELECT station, year, 'full_min', full_min FROM y
      UNION ALL SELECT station, year, 'days_100', days_100 FROM y
      UNION ALL SELECT station, year, 'frost_days', frost_days FROM y
      UNION ALL SELECT station, year, 'diurnal_temp_range', diurnal_temp_range FROM y),
r AS (SELECT *, CASE WHEN total IS NOT NULL THEN
          CAST(rank() OVER (PARTITION BY station, metric_name ORDER BY total DESC NULLS LAST) AS INTEGER) END AS rank FROM l),
mx AS (SELECT station, max(year(date)) AS maxy FROM daily_temps GROUP BY 1)
SELECT r.* FROM r JOIN mx USING (station) WHERE r.year < mx.maxy""")
def q_temp_year_metrics(spark, sf_dir):
    """Yearly max, min, hot-day and frost-day counts and mean diurnal range, ranked per metric,
    last year dropped."""
    from climo.operators import aggregates as agg
    return agg.temp_year_metrics(fx.daily_temps(spark, sf_dir), fx.HOT_THRESHOLD, fx.FREEZE_THRESHOLD)


@register("frost_dates", with_fixtures("daily_temps") + f"""
SELECT station, {_YR} AS year,
  max(CASE WHEN min_temp <= {fx.FREEZE_THRESHOLD} AND {doy_sql('date')} < 200 THEN {doy_sql('date')} END) AS last_frost,
  min(CASE WHEN min_temp <= {fx.FREEZE_THRESHOLD} AND {doy_sql('date')} > 200 THEN {doy_sql('date')} END) AS first_frost
FROM daily_temps GROUP BY 1, 2""")
def q_frost_dates(spark, sf_dir):
    """Per year the last frost index before day 200 and the first after it."""
    from climo.operators import aggregates as agg
    return agg.frost_dates(fx.daily_temps(spark, sf_dir), fx.FREEZE_THRESHOLD)


def _season_bounds_sql(src: str) -> str:
    return f"""bounds AS (SELECT station,
    CASE WHEN month(min(date)) >= 8 THEN year(min(date)) + 1 ELSE year(min(date)) END AS min_season,
    CASE WHEN month(max(date)) < 7 THEN year(max(date)) - 1 ELSE year(max(date)) END AS max_season
  FROM {src} GROUP BY station)"""


def _season_events_sql(src: str, cond: str, prefix: str) -> str:
    ss = "CAST(year(date) - CASE WHEN month(date) >= 8 THEN 0 ELSE 1 END AS INTEGER)"
    return f""", {_season_bounds_sql(src)},
ev AS (SELECT station, {ss} AS season_start, date, {doy_sql('date', 153)} AS sdoy FROM {src} WHERE {cond}),
g AS (SELECT station, CAST(season_start AS VARCHAR) || '-' || CAST(season_start + 1 AS VARCHAR) AS snow_season,
        season_start, min(sdoy) AS first_{prefix}_doy, min(date) AS first_{prefix}_date, max(sdoy) AS last_{prefix}_doy
      FROM ev GROUP BY station, season_start),
se AS (SELECT g.* FROM g JOIN bounds USING (station)
       WHERE g.season_start >= bounds.min_season AND g.season_start < bounds.max_season)"""


@register("freeze_dates", with_fixtures("daily_temps")
          + _season_events_sql("daily_temps", f"min_temp <= {fx.FREEZE_THRESHOLD}", "freeze") + "\nSELECT * FROM se")
def q_freeze_dates(spark, sf_dir):
    """First / last freeze per complete snow season."""
    from climo.operators import aggregates as agg
    return agg.season_event_dates(fx.daily_temps(spark, sf_dir), F.col("min_temp") <= fx.FREEZE_THRESHOLD,
                                  prefix="freeze")


@register("snow_dates", with_fixtures("precip_silver")
          + _season_events_sql("silver", "snow > 0", "snow") + "\nSELECT * FROM se")
def q_snow_dates(spark, sf_dir):
    """First / last snow per complete snow season."""
    from climo.operators import aggregates as agg
    return agg.season_event_dates(fx.precip_silver(spark, sf_dir), F.col("snow") > 0, prefix="snow")


def _label_sql(d: str) -> str:
    return (f"CASE WHEN {d} = 59.5 THEN 'Feb 29' "
            f"ELSE strftime(DATE '2025-01-01' + CAST(floor({d}) - 1 AS INTEGER), '%b %d') END")


_QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _event_pct_sql(src_col: str, metric: str) -> str:
    parts = []
    for p in _QS:
        q = f"quantile_cont({src_col}, {p})"
        cal_idx = f"CAST(floor((({q} - 154) % 365.0 + 365.0) % 365.0 + 1) AS INTEGER)"
        parts.append(f"SELECT station, '{metric}' AS metric, '{int(p * 100)}th Percentile' AS percentile, "
                     f"{q} AS season_doy, {_label_sql(cal_idx)} AS date FROM se GROUP BY station")
    return "\nUNION ALL ".join(parts)


@register("freeze_date_percentiles", with_fixtures("daily_temps")
          + _season_events_sql("daily_temps", f"min_temp <= {fx.FREEZE_THRESHOLD}", "freeze")
          + "\n" + _event_pct_sql("first_freeze_doy", "first_freeze")
          + "\nUNION ALL " + _event_pct_sql("last_freeze_doy", "last_freeze"))
def q_freeze_date_percentiles(spark, sf_dir):
    """Quantiles of first / last freeze index as calendar labels."""
    from climo.operators import aggregates as agg
    fd = agg.season_event_dates(fx.daily_temps(spark, sf_dir), F.col("min_temp") <= fx.FREEZE_THRESHOLD,
                                prefix="freeze")
    return (agg.event_date_percentiles(fd, "first_freeze_doy", "first_freeze")
            .unionByName(agg.event_date_percentiles(fd, "last_freeze_doy", "last_freeze")))


@register("season_snow_summary", with_fixtures("precip_silver") + """
, g AS (SELECT station, CAST(year(date) - CASE WHEN month(date) >= 9 THEN 0 ELSE 1 END AS INTEGER) AS season_year,
          coalesce(sum(snow), 0.0) AS total_snow, min(CASE WHEN snow > 0 THEN date END) AS first_snow,
          max(CASE WHEN snow > 0 THEN date END) AS last_snow FROM silver GROUP BY 1, 2)
SELECT *, CAST(floor(rank() OVER (PARTITION BY station ORDER BY total_snow DESC)
              + (count(*) OVER (PARTITION BY station, total_snow) - 1) / 2.0) AS INTEGER) AS snow_rank FROM g""")
def q_season_snow_summary(spark, sf_dir):
    """Per Sep-start season total snow, first and last snow date, rank with average ties
    truncated."""
    from climo.operators import aggregates as agg
    return agg.season_snow_summary(fx.precip_silver(spark, sf_dir))


@register("snow_to_date_median", with_fixtures("precip_silver") + f"""
, c AS (SELECT station, snow_season, {doy_sql('date', 153)} AS snow_day_of_year,
          sum(coalesce(snow, 0.0)) OVER (PARTITION BY station, snow_season ORDER BY date
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS snow_to_date FROM silver)
SELECT station, snow_day_of_year, median(snow_to_date) AS median_to_date FROM c GROUP BY 1, 2""")
def q_snow_to_date_median(spark, sf_dir):
    """W9 + A23: season-to-date snow and its median across seasons per season day."""
    from climo.operators import accumulate
    s = fx.precip_silver(spark, sf_dir).withColumn("snow_day_of_year", cal.doy_index("date", "snow_season"))
    s = accumulate.season_to_date(s, "snow")
    return accumulate.to_date_median(s, "snow_to_date", ["station", "snow_day_of_year"])


# ---------------------------------------------------------------------------
# Hourly (A24-A27), wind rose (A28), distributions (A29-A32), departures

_HOURLY_METRICS = ["temp", "humidity", "wind_speed", "dew_point", "precip", "cloud_cover"]


def _hourly_attr_sql() -> str:
    season = ("CASE WHEN month(timestamp) IN (12, 1, 2) THEN 'winter' WHEN month(timestamp) IN (3, 4, 5) THEN 'spring' "
              "WHEN month(timestamp) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END")
    return f""", h AS (SELECT *, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(year(timestamp) AS INTEGER) AS year,
       strftime(timestamp, '%b') AS month, CAST(month(timestamp) AS INTEGER) AS month_num,
       {doy_sql('CAST(timestamp AS DATE)')} AS day_of_year,
       CASE WHEN precip > 0 THEN 1.0 ELSE 0.0 END AS precip_chance, {season} AS season FROM hourly)"""


def _hourly_long_sql(metrics) -> str:
    sel = "\n  UNION ALL ".join(
        f"SELECT station, timestamp, month, month_num, hour, year, day_of_year, season, '{m}' AS metric_name, "
        f"CAST({m} AS DOUBLE) AS metric_value FROM h" for m in metrics)
    return f", hl AS ({sel})"


@register("hourly_means", with_fixtures("hourly") + _hourly_attr_sql() + f"""
SELECT station, hour, {', '.join(f'avg({m}) AS {m}' for m in _HOURLY_METRICS)} FROM h GROUP BY 1, 2""")
def q_hourly_means(spark, sf_dir):
    """Mean of six hourly metrics by hour of day."""
    from climo.operators import aggregates as agg
    return agg.hourly_means(fx.hourly(spark, sf_dir), _HOURLY_METRICS)


@register("hourly_season_means", with_fixtures("hourly") + _hourly_attr_sql() + f"""
SELECT station, hour, season, {', '.join(f'avg({m}) AS {m}' for m in _HOURLY_METRICS)} FROM h GROUP BY 1, 2, 3""")
def q_hourly_season_means(spark, sf_dir):
    """Mean of six hourly metrics by hour of day and season."""
    from climo.operators import aggregates as agg
    return agg.hourly_means(fx.hourly(spark, sf_dir), _HOURLY_METRICS, by_season=True)


_HM = _HOURLY_METRICS + ["precip_chance"]


@register("hourly_by_month", with_fixtures("hourly") + _hourly_attr_sql() + _hourly_long_sql(_HM) + """
, my AS (SELECT station, year, month, month_num, hour, metric_name, avg(metric_value) AS metric_value FROM hl GROUP BY ALL)
SELECT station, month, month_num, hour, metric_name, avg(metric_value) AS metric_value,
  CASE WHEN month_num IN (12, 1, 2) THEN 'winter' WHEN month_num IN (3, 4, 5) THEN 'spring'
       WHEN month_num IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season
FROM my GROUP BY 1, 2, 3, 4, 5""")
def q_hourly_by_month(spark, sf_dir):
    """Hourly means per (year, month) → per month (mean of yearly means)."""
    from climo.operators import aggregates as agg
    return agg.hourly_cascade(fx.hourly(spark, sf_dir), _HM)[1]


@register("hourly_by_month_years", with_fixtures("hourly") + _hourly_attr_sql() + _hourly_long_sql(_HM) + """
SELECT station, year, month, month_num, hour, metric_name, avg(metric_value) AS metric_value FROM hl GROUP BY ALL""")
def q_hourly_by_month_years(spark, sf_dir):
    """V5: the yearly points behind the monthly mean line (hourly means per year and month)."""
    from climo.operators import aggregates as agg
    return agg.hourly_cascade(fx.hourly(spark, sf_dir), _HM)[0]


@register("hourly_season_deviation", with_fixtures("hourly") + _hourly_attr_sql() + _hourly_long_sql(_HM) + """
, my AS (SELECT station, year, month, month_num, hour, metric_name, avg(metric_value) AS metric_value FROM hl GROUP BY ALL),
mo AS (SELECT station, month_num, hour, metric_name, avg(metric_value) AS metric_value FROM my GROUP BY ALL),
se AS (SELECT station, CASE WHEN month_num IN (12, 1, 2) THEN 'winter' WHEN month_num IN (3, 4, 5) THEN 'spring'
           WHEN month_num IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season, hour, metric_name,
         avg(metric_value) AS metric_value FROM mo GROUP BY ALL)
SELECT *, metric_value - avg(metric_value) OVER (PARTITION BY station, season, metric_name) AS avg_deviation FROM se""")
def q_hourly_season_deviation(spark, sf_dir):
    """V6/V7: season × hour means (mean of monthly means) and deviation from the season mean."""
    from climo.plans import views
    return views.hourly_season_deviation(fx.hourly(spark, sf_dir), _HM)


@register("hourly_heatmap", with_fixtures("hourly") + _hourly_attr_sql() + _hourly_long_sql(_HM) + f"""
SELECT station, day_of_year, hour, metric_name, avg(metric_value) AS metric_value,
       {_label_sql('day_of_year')} AS doy_label FROM hl GROUP BY 1, 2, 3, 4""")
def q_hourly_heatmap(spark, sf_dir):
    """Mean of each hourly metric by day index and hour, with the calendar label."""
    from climo.operators import aggregates as agg
    return agg.hourly_heatmap(fx.hourly(spark, sf_dir), _HM)


@register("hourly_year_summary", with_fixtures("hourly") + """
SELECT station, CAST(year(timestamp) AS INTEGER) AS year, min(temp) AS min_temp, max(temp) AS max_temp,
       coalesce(sum(precip), 0.0) AS total_precip, coalesce(sum(snow), 0.0) AS total_snow,
       avg(cloud_cover) AS cloud_cover_avg FROM hourly GROUP BY 1, 2""")
def q_hourly_year_summary(spark, sf_dir):
    """Per year min / max temperature, precipitation and snow totals, mean cloud cover."""
    from climo.operators import aggregates as agg
    return agg.hourly_year_summary(fx.hourly(spark, sf_dir))


_SPEED_LABEL_SQL = """CASE WHEN wind_speed > 0 AND wind_speed <= 10 THEN '0-10'
  WHEN wind_speed > 10 AND wind_speed <= 15 THEN '10-15' WHEN wind_speed > 15 AND wind_speed <= 20 THEN '15-20'
  WHEN wind_speed > 20 AND wind_speed <= 30 THEN '20-30' WHEN wind_speed > 30 AND wind_speed <= 40 THEN '30-40'
  WHEN wind_speed > 40 AND wind_speed <= maxs THEN '40+' END"""


@register("wind_rose", with_fixtures("wind") + f"""
, mx AS (SELECT station, max(wind_speed) AS maxs FROM wind GROUP BY 1),
b AS (SELECT w.station, {_SPEED_LABEL_SQL} AS wind_speed_cat,
        ((round_even(wind_direction / 22.5, 0) * 22.5) % 360.0 + 360.0) % 360.0 AS wind_direction_cat
      FROM wind w JOIN mx USING (station)),
c AS (SELECT station, wind_speed_cat, wind_direction_cat, count(*) AS frequency FROM b
      WHERE wind_speed_cat IS NOT NULL AND wind_direction_cat IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, frequency / sum(frequency) OVER (PARTITION BY station) AS share FROM c""")
def q_wind_rose(spark, sf_dir):
    """Speed bin × 16-point direction counts and share of total."""
    from climo.operators import aggregates as agg
    return agg.wind_rose(fx.wind(spark, sf_dir))


@register("record_day_counts", with_fixtures("daily_temps") + f"""
, t AS (SELECT *, {doy_sql('date')} AS day_of_year FROM daily_temps),
r AS (SELECT *, rank() OVER (PARTITION BY station, day_of_year ORDER BY max_temp DESC NULLS LAST) AS hi,
             rank() OVER (PARTITION BY station, day_of_year ORDER BY max_temp ASC NULLS LAST) AS lo FROM t)
SELECT station, {_YR} AS year, CAST(count_if(hi = 1) AS BIGINT) AS record_highs,
       CAST(-count_if(lo = 1) AS BIGINT) AS record_lows FROM r GROUP BY 1, 2""")
def q_record_day_counts(spark, sf_dir):
    """Per year, days setting a day-of-year record high (+) / low (−) of the daily high."""
    from climo.operators import aggregates as agg
    return agg.record_day_counts(fx.daily_temps(spark, sf_dir), "max_temp")


@register("record_day_counts_rain", with_fixtures("precip_silver") + f"""
, t AS (SELECT *, {doy_sql('date')} AS doy FROM silver),
r AS (SELECT *, rank() OVER (PARTITION BY station, doy ORDER BY rain DESC NULLS LAST) AS hi,
             rank() OVER (PARTITION BY station, doy ORDER BY rain ASC NULLS LAST) AS lo FROM t)
SELECT station, {_YR} AS year, CAST(count_if(hi = 1) AS BIGINT) AS record_highs,
       CAST(-count_if(lo = 1) AS BIGINT) AS record_lows FROM r WHERE rain > 0 GROUP BY 1, 2""")
def q_record_day_counts_rain(spark, sf_dir):
    """Days setting a day-of-year rain record, dry days left out after ranking."""
    from climo.operators import aggregates as agg
    return agg.record_day_counts(fx.precip_silver(spark, sf_dir).drop("day_of_year"), "rain", positive_only=True)


@register("hourly_heatmap_temp", with_fixtures("hourly") + f"""
SELECT station, {doy_sql('CAST(timestamp AS DATE)')} AS day_of_year, CAST(hour(timestamp) AS INTEGER) AS hour,
  strftime(CAST(timestamp AS DATE), '%b %d') AS doy_label, 'temp' AS metric_name, avg(CAST(temp AS DOUBLE)) AS metric_value
FROM hourly WHERE strftime(timestamp, '%m-%d') <> '02-29' GROUP BY ALL""")
def q_hourly_heatmap_temp(spark, sf_dir):
    """V8: the heatmap of one metric, without the leap-day index."""
    from climo.operators import aggregates as agg
    return agg.hourly_heatmap(fx.hourly(spark, sf_dir), ["temp"], drop_leap_day=True)


@register("histogram_percent", with_fixtures("daily_temps") + """
, b AS (SELECT station, floor((min_temp - 0.0) / 25000.0) * 25000.0 + 0.0 AS bin_start, count(*) AS n
        FROM daily_temps WHERE min_temp IS NOT NULL GROUP BY 1, 2)
SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY station) AS percent FROM b""")
def q_histogram_percent(spark, sf_dir):
    """Percent of days per fixed-width bin of the daily low."""
    from climo.operators import aggregates as agg
    return agg.histogram_percent(fx.daily_temps(spark, sf_dir), "min_temp", 25000.0, keys=["station"])


@register("density_2d", with_fixtures("hourly") + """
, b AS (SELECT CASE WHEN temp < 0 THEN 0 WHEN temp >= 100 THEN 101 ELSE CAST(floor((temp - 0.0) / 1.0) AS BIGINT) + 1 END AS x_bin,
               CASE WHEN humidity < 0 THEN 0 WHEN humidity >= 100 THEN 101 ELSE CAST(floor((humidity - 0.0) / 1.0) AS BIGINT) + 1 END AS y_bin
        FROM hourly WHERE temp IS NOT NULL AND humidity IS NOT NULL),
c AS (SELECT x_bin, y_bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT x_bin, y_bin, CAST(sum(n) AS BIGINT) AS n, CAST(grouping(x_bin, y_bin) AS INTEGER) AS level FROM c
GROUP BY GROUPING SETS ((x_bin, y_bin), (x_bin), (y_bin))""")
def q_density_2d(spark, sf_dir):
    """100 × 100 grid of (temp, humidity) counts plus both marginals."""
    from climo.operators import aggregates as agg
    return agg.density_2d(fx.hourly(spark, sf_dir), "temp", "humidity", (0.0, 100.0), (0.0, 100.0))


@register("grouped_avg", with_fixtures("category_measures") + """
SELECT continent, avg(measure) AS avg_measure FROM category_measures GROUP BY 1""")
def q_grouped_avg(spark, sf_dir):
    """Mean of a measure per category (continent)."""
    from climo.operators import aggregates as agg
    return agg.grouped_avg(fx.category_measures(spark, sf_dir), "continent", "measure")


# ---------------------------------------------------------------------------
# Records (V29-V32)

_N = 15
_SS = "CAST(year(date) - CASE WHEN month(date) >= 8 THEN 0 ELSE 1 END AS INTEGER)"


def _rec_sel(rank: str, date: str, metric: str, value: str, month: str, record: str) -> str:
    return (f"SELECT station, CAST({rank} AS INTEGER) AS rank, CAST({date} AS VARCHAR) AS date, "
            f"{metric} AS metric_name, CAST({value} AS DOUBLE) AS metric_value, {month} AS month, {record} AS record")


_TEMP_RECORDS_SQL = with_fixtures("daily_temps") + f"""
, d AS (SELECT *, strftime(date, '%b') AS month, {_SS} AS season_start, {doy_sql('date', 153)} AS sdoy FROM daily_temps),
l AS (SELECT station, date, month, 'max_temp' AS metric_name, max_temp AS metric_value FROM d
      UNION ALL SELECT station, date, month, 'min_temp', min_temp FROM d),
r AS (SELECT *, rank() OVER (PARTITION BY station, metric_name, month ORDER BY metric_value DESC) AS wm,
              rank() OVER (PARTITION BY station, metric_name ORDER BY metric_value DESC) AS wo,
              rank() OVER (PARTITION BY station, metric_name, month ORDER BY metric_value ASC) AS cm,
              rank() OVER (PARTITION BY station, metric_name ORDER BY metric_value ASC) AS co
      FROM l WHERE metric_value IS NOT NULL),
fam AS (
  {_rec_sel('wm', 'date', 'metric_name', 'metric_value', 'month', "'hottest_day (' || month || ')'")} FROM r WHERE metric_name = 'max_temp' AND wm <= {_N}
  UNION ALL {_rec_sel('wo', 'date', 'metric_name', 'metric_value', 'month', "'hottest_day'")} FROM r WHERE metric_name = 'max_temp' AND wo <= {_N}
  UNION ALL {_rec_sel('cm', 'date', 'metric_name', 'metric_value', 'month', "'coldest_day (' || month || ')'")} FROM r WHERE metric_name = 'min_temp' AND cm <= {_N}
  UNION ALL {_rec_sel('co', 'date', 'metric_name', 'metric_value', 'month', "'coldest_day'")} FROM r WHERE metric_name = 'min_temp' AND co <= {_N}
  UNION ALL {_rec_sel('co', 'date', 'metric_name', 'metric_value', 'month', "'coldest_maximum'")} FROM r WHERE metric_name = 'max_temp' AND co <= {_N}
  UNION ALL {_rec_sel('wo', 'date', 'metric_name', 'metric_value', 'month', "'hottest_minimum'")} FROM r WHERE metric_name = 'min_temp' AND wo <= {_N}),
hy AS (SELECT station, year(date) AS year, CAST(count_if(max_temp >= {fx.HOT_THRESHOLD}) AS DOUBLE) AS v FROM d GROUP BY 1, 2),
hyr AS (SELECT *, rank() OVER (PARTITION BY station ORDER BY v DESC) AS rk FROM hy),
{_season_bounds_sql('daily_temps')},
fz AS (SELECT * FROM d WHERE min_temp <= {fx.FREEZE_THRESHOLD}),
ff AS (SELECT fz.*, rank() OVER (PARTITION BY station, season_start ORDER BY sdoy ASC) AS fn,
              rank() OVER (PARTITION BY station, season_start ORDER BY sdoy DESC) AS ln FROM fz),
ff1 AS (SELECT ff.*, rank() OVER (PARTITION BY station ORDER BY sdoy ASC) AS rk FROM ff JOIN bounds USING (station)
        WHERE fn = 1 AND season_start >= min_season),
lf1 AS (SELECT ff.*, rank() OVER (PARTITION BY station ORDER BY sdoy DESC) AS rk FROM ff JOIN bounds USING (station)
        WHERE ln = 1 AND season_start < max_season)
SELECT * FROM fam
UNION ALL {_rec_sel('rk', 'year', "'100 Degree Days'", 'v', "'Year'", "'100_degree_days'")} FROM hyr WHERE rk <= {_N}
UNION ALL {_rec_sel('rk', 'date', "'Freeze'", 'min_temp', "'Year'", "'first_freeze'")} FROM ff1 WHERE rk <= {_N}
UNION ALL {_rec_sel('rk', 'date', "'Freeze'", 'min_temp', "'Year'", "'last_freeze'")} FROM lf1 WHERE rk <= {_N}"""


@register("temp_records", _TEMP_RECORDS_SQL)
def q_temp_records(spark, sf_dir):
    """All temperature record families, top 15 with ties, per station."""
    from climo.operators import records
    return records.temp_records(fx.daily_temps(spark, sf_dir), _N, fx.HOT_THRESHOLD, fx.FREEZE_THRESHOLD)


@register("temp_records_sorted", f"""SELECT *, row_number() OVER (ORDER BY record NULLS FIRST, rank NULLS FIRST, station NULLS FIRST, date NULLS FIRST,
  metric_name NULLS FIRST, month NULLS FIRST, metric_value NULLS FIRST) AS position FROM ({_TEMP_RECORDS_SQL})""")
def q_temp_records_sorted(spark, sf_dir):
    """O1 on V29: the record table written in the global order of record and rank, read back with each row's place."""
    from climo.sources import landing
    path = _landing_path(spark, "records")
    landing.write_sorted(q_temp_records(spark, sf_dir), path, ["record", "rank", "station", "date", "metric_name", "month", "metric_value"])
    return landing.sorted_rows(spark, path)


@register("daily_precip_records", with_fixtures("precip_silver") + f"""
, wet AS (SELECT station, date, month, year, season_start, 'rain' AS metric_name, rain AS metric_value FROM silver WHERE rain > 0
          UNION ALL SELECT station, date, month, year, season_start, 'snow', snow FROM silver WHERE snow > 0),
w AS (SELECT *, {doy_sql('date', 153)} AS day_of_year,
        rank() OVER (PARTITION BY station, metric_name, month ORDER BY metric_value DESC) AS rm,
        rank() OVER (PARTITION BY station, metric_name ORDER BY metric_value DESC) AS ro FROM wet),
es AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY day_of_year ASC, date ASC) AS rn,
              rank() OVER (PARTITION BY station ORDER BY day_of_year ASC) AS rk FROM w WHERE metric_name = 'snow'),
my AS (SELECT station, min(year) AS min_year FROM wet GROUP BY 1),
ls AS (SELECT w.*, row_number() OVER (PARTITION BY station ORDER BY day_of_year DESC, date ASC) AS rn,
              rank() OVER (PARTITION BY station ORDER BY day_of_year DESC) AS rk
       FROM w JOIN my USING (station) WHERE metric_name = 'snow' AND season_start >= min_year),
gaps AS (SELECT station, date, datediff('day', lag(date) OVER (PARTITION BY station ORDER BY date), date) - 1 AS gap
         FROM silver WHERE precip_day = 1),
gr AS (SELECT *, rank() OVER (PARTITION BY station ORDER BY gap DESC) AS rk FROM gaps WHERE gap IS NOT NULL)
{_rec_sel('rm', 'date', 'metric_name', 'metric_value', 'month', "metric_name || 'iest day (' || month || ')'")} FROM w WHERE rm <= {_N}
UNION ALL {_rec_sel('ro', 'date', 'metric_name', 'metric_value', "'ALL'", "metric_name || 'iest day'")} FROM w WHERE ro <= {_N}
UNION ALL {_rec_sel('rk', 'date', "'precip'", 'gap', "'ALL'", "'consecutive_days_dry'")} FROM gr WHERE rk <= {_N} AND gap > 0
UNION ALL {_rec_sel('rk', 'date', 'metric_name', 'metric_value', "'ALL'", "'latest_snow'")} FROM ls WHERE rn <= {_N}
UNION ALL {_rec_sel('rk', 'date', 'metric_name', 'metric_value', "'ALL'", "'earliest_snow'")} FROM es WHERE rn <= {_N}""")
def q_daily_precip_records(spark, sf_dir):
    """Wettest days, longest dry gaps (W10), earliest / latest snow."""
    from climo.operators import records
    return records.daily_precip_records(fx.precip_silver(spark, sf_dir), _N)


_register_monthly_records = register("monthly_precip_records", with_fixtures("precip_silver") + f"""
, mx AS (SELECT station, max(date) AS mx FROM silver GROUP BY station),
m AS (SELECT s.station, date_trunc('month', s.date) AS first, s.month, coalesce(sum(precip), 0.0) AS precip,
        coalesce(sum(snow), 0.0) AS snow, coalesce(sum(rain), 0.0) AS rain
      FROM silver s JOIN mx USING (station) WHERE s.date <= {_last_month_end('mx.mx')} GROUP BY 1, 2, 3),
t AS (SELECT *, CAST(year(first) AS VARCHAR) AS yr, CAST(year(first) - CASE WHEN month(first) >= 8 THEN 0 ELSE 1 END AS INTEGER) AS ss FROM m),
f AS (SELECT station, month || ' ' || yr AS date, rain AS metric_value, 'rainiest_month' AS record, -rain AS k FROM t
  UNION ALL SELECT station, month || ' ' || yr, snow, 'snowiest_month', -snow FROM t
  UNION ALL SELECT station, month || ' ' || yr, precip, 'driest_month', precip FROM t
  UNION ALL SELECT station, yr, sum(rain), 'most_rain_year', -sum(rain) FROM t GROUP BY station, yr HAVING count(*) = 12
  UNION ALL SELECT station, ss || '-' || (ss + 1), sum(snow), 'most_snow_year', -sum(snow) FROM t GROUP BY station, ss HAVING count(*) = 12
  UNION ALL SELECT station, ss || '-' || (ss + 1), sum(snow), 'least_snow_year', sum(snow) FROM t GROUP BY station, ss HAVING count(*) = 12),
r AS (SELECT *, CAST(rank() OVER (PARTITION BY station, record ORDER BY k) AS INTEGER) AS rank FROM f)
SELECT station, rank, date, metric_value, record FROM r WHERE rank <= {_N}""")


@_register_monthly_records
def q_monthly_precip_records(spark, sf_dir):
    """Rainiest / snowiest / driest months, snowiest and least snowy seasons, rainiest years."""
    from climo.operators import records
    from climo.plans import views
    pr = views.monthly_precip_rank(fx.precip_silver(spark, sf_dir), year_types=["calendar_year", "snow_season"])
    return records.monthly_precip_records(pr, _N)


@register("records_page_hottest_day", "WITH rec AS (" + _TEMP_RECORDS_SQL + """),
f AS (SELECT * FROM rec WHERE record = 'hottest_day'),
o AS (""" + with_fixtures("daily_temps") + """ SELECT station, date FROM daily_temps),
a AS (SELECT station, CAST(max(year(date)) AS INTEGER) AS as_of_year FROM o GROUP BY 1)
SELECT station, rank, date, round_even(metric_value, 2) AS metric_value,
  (contains(date, CAST(as_of_year AS VARCHAR)) OR contains(date, CAST(as_of_year - 1 AS VARCHAR))
   OR contains(date, CAST(as_of_year - 2 AS VARCHAR))) AS recent
FROM f JOIN a USING (station)""")
def q_records_page_hottest_day(spark, sf_dir):
    """One record family as a page with the 'set in the last 3 years' flag."""
    from climo.operators import records
    daily = fx.daily_temps(spark, sf_dir)
    rec = records.temp_records(daily, _N, fx.HOT_THRESHOLD, fx.FREEZE_THRESHOLD)
    return records.records_page(rec, "hottest_day", observed=daily)


# ---------------------------------------------------------------------------
# Sequence windows (W10-W15), top-k

@register("dry_gaps", with_fixtures("precip_silver") + """
SELECT station, date, precip_day,
       CAST(datediff('day', lag(date) OVER (PARTITION BY station ORDER BY date), date) - 1 AS INTEGER) AS dry_days
FROM silver WHERE precip_day = 1""")
def q_dry_gaps(spark, sf_dir):
    """Days between consecutive wet days."""
    from climo.operators import windows
    s = fx.precip_silver(spark, sf_dir).select("station", "date", "precip_day")
    return windows.gap_since_previous(s, F.col("precip_day") == 1)


@register("precip_streaks", with_fixtures("precip_silver") + """
, s AS (SELECT station, date, CASE WHEN snow > 0 THEN 1 ELSE 0 END AS state FROM silver),
c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY station ORDER BY date) IS NOT DISTINCT FROM state
                     THEN 0 ELSE 1 END AS chg FROM s),
i AS (SELECT *, sum(chg) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS streak_id FROM c)
SELECT station, CAST(streak_id AS BIGINT) AS streak_id, state, min(date) AS start, max(date) AS "end",
       count(*) AS length FROM i GROUP BY 1, 2, 3""")
def q_precip_streaks(spark, sf_dir):
    """Islands of consecutive rows with / without snow (row-based, Q19)."""
    from climo.operators import windows
    s = fx.precip_silver(spark, sf_dir)
    st = windows.state_streaks(s, F.when(F.col("snow") > 0, 1).otherwise(0))
    return windows.streak_summary(st)


@register("rolling_mean_365", with_fixtures("daily_temps") + """
SELECT station, date, avg_temp,
  CASE WHEN count(avg_temp) OVER w >= 180 THEN avg(avg_temp) OVER w END AS avg_temp_rolling
FROM daily_temps WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN 364 PRECEDING AND CURRENT ROW)""")
def q_rolling_mean_365(spark, sf_dir):
    """365-row trailing mean with at least 180 observations."""
    from climo.operators import windows
    return windows.rolling_mean(fx.daily_temps(spark, sf_dir).select("station", "date", "avg_temp"), "avg_temp")


@register("hottest_hour_by_month", ORACLE["hourly_by_month"].replace(
    "SELECT station, month, month_num, hour, metric_name, avg(metric_value) AS metric_value,",
    ", mm AS (SELECT station, month, month_num, hour, metric_name, avg(metric_value) AS metric_value,", 1) + """)
SELECT station, month, first(hour ORDER BY metric_value DESC, hour ASC) AS hour,
       max(metric_value) AS metric_value FROM mm WHERE metric_name = 'temp' GROUP BY 1, 2""")
def q_hottest_hour_by_month(spark, sf_dir):
    """Hour with the highest mean temperature per month (max_by, no sort)."""
    from climo.operators import aggregates as agg
    from climo.operators import windows
    month = agg.hourly_cascade(fx.hourly(spark, sf_dir), _HM)[1].filter(F.col("metric_name") == "temp")
    return windows.argmax_row(month, ["station", "month"], "metric_value", ["hour", "metric_value"],
                              largest=True, tie_col="hour")


@register("top_temperature_swings", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) - min(o_totalprice) AS swing FROM orders GROUP BY 1)
SELECT date, swing FROM d ORDER BY swing DESC, date ASC LIMIT 10""")
def q_top_temperature_swings(spark, sf_dir):
    """The 10 days with the largest high−low swing (TakeOrderedAndProject)."""
    from climo.functions import derive as dv
    d = fx.daily_temps(spark, sf_dir, dense=True)
    d = d.select("date", dv.diurnal_range("max_temp", "min_temp").alias("swing"))
    return ranks.top_k(d, "swing", 10, ascending=False, tie_break=["date"])


@register("temps_with_precip", with_fixtures("daily_temps", "precip_silver") + """
SELECT t.station, t.date, t.max_temp, t.min_temp, t.avg_temp, s.precip, s.rain, s.snow
FROM daily_temps t LEFT JOIN silver s ON t.station = s.station AND t.date = s.date""")
def q_temps_with_precip(spark, sf_dir):
    """Daily temperatures ⟕ daily precipitation on (station, date)."""
    t = fx.daily_temps(spark, sf_dir).select("station", "date", "max_temp", "min_temp", "avg_temp")
    s = fx.precip_silver(spark, sf_dir).select("station", "date", "precip", "rain", "snow")
    return t.join(s, ["station", "date"], "left")


# ---------------------------------------------------------------------------
# Normals joins and departures (J1, F16, A35, V1, V3), pivot (R2)

_DOY_NORMALS_SQL = f"""
, tn AS (SELECT *, {doy_sql('date')} AS day_of_year FROM daily_temps),
nrm AS (SELECT station, day_of_year, avg(max_temp) AS normal_high, avg(min_temp) AS normal_low,
               avg(avg_temp) AS normal_temp
        FROM tn WHERE year(date) BETWEEN {fx.NORMAL_START} AND {fx.NORMAL_END} GROUP BY 1, 2),
j AS (SELECT tn.*, nrm.normal_high, nrm.normal_low, nrm.normal_temp FROM tn
      LEFT JOIN nrm ON tn.station = nrm.station AND tn.day_of_year = nrm.day_of_year)"""


def _doy_normals(spark, sf_dir):
    from climo.plans import views
    return views.normals_from_doy_means(fx.daily_temps(spark, sf_dir), _NORMAL_YEARS)


@register("departure_month_mean", with_fixtures("daily_temps") + _DOY_NORMALS_SQL + """
SELECT station, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month_num,
       avg(max_temp - normal_high) AS departure_high, avg(min_temp - normal_low) AS departure_low,
       avg(avg_temp - normal_temp) AS departure_mean FROM j GROUP BY 1, 2, 3""")
def q_departure_month_mean(spark, sf_dir):
    """Facts ⟕ day-of-year normals (J1) → departures (F16) → monthly mean."""
    from climo.plans import views
    return views.departure_month_mean(fx.daily_temps(spark, sf_dir), _doy_normals(spark, sf_dir))


@register("temp_band_window", with_fixtures("daily_temps") + _DOY_NORMALS_SQL + """
, r AS (SELECT *, CAST(rank() OVER (PARTITION BY station, day_of_year ORDER BY max_temp DESC) AS INTEGER) AS high_rank,
              CAST(rank() OVER (PARTITION BY station, day_of_year ORDER BY min_temp ASC) AS INTEGER) AS low_rank FROM j),
w AS (SELECT * FROM r WHERE year(date) BETWEEN 1997 AND 2001)
SELECT station, date, max_temp, min_temp, normal_high, normal_low, high_rank, low_rank,
       high_rank = 1 AS record_high, low_rank = 1 AS record_low,
       low_rank = max(low_rank) OVER (PARTITION BY station) AS warmest_low,
       high_rank = max(high_rank) OVER (PARTITION BY station) AS coldest_high FROM w""")
def q_temp_band_window(spark, sf_dir):
    """V1: five-year window with normals, record flags and window extremes."""
    from climo.plans import views
    return views.temp_band_window(fx.daily_temps(spark, sf_dir), _doy_normals(spark, sf_dir), 1997)


@register("calendar_departure", with_fixtures("daily_temps") + _DOY_NORMALS_SQL + """
SELECT station, date, max_temp AS value, max_temp - normal_high AS departure FROM j
WHERE year(date) BETWEEN 1997 AND 2001""")
def q_calendar_departure(spark, sf_dir):
    """V3: daily departure of the high from normal over five years."""
    from climo.plans import views
    return views.calendar_departure(fx.daily_temps(spark, sf_dir), _doy_normals(spark, sf_dir), "max_temp", 1997)


@register("monthly_mean_pivot", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS max_temp FROM orders GROUP BY 1),
m AS (SELECT strftime(date, '%b') AS month, CAST(year(date) AS INTEGER) AS year, avg(max_temp) AS mean FROM d GROUP BY 1, 2)
SELECT a.month, CAST(b.year AS VARCHAR) AS year, m.mean
FROM (SELECT DISTINCT month FROM m) a CROSS JOIN (SELECT DISTINCT year FROM m) b LEFT JOIN m ON m.month = a.month AND m.year = b.year""")
def q_monthly_mean_pivot(spark, sf_dir):
    """The month x year matrix of monthly mean highs over all years of the table, read off as one row per cell."""
    from climo.operators import aggregates as agg
    from climo.operators import reshape
    m = agg.monthly_means(fx.daily_temps(spark, sf_dir, dense=True), ["max_temp"], keys=[])
    years = [str(r[0]) for r in m.select("year").distinct().orderBy("year").collect()]      # one value per year
    wide = reshape.pivot_years(m.withColumn("year", F.col("year").cast("string")), "month", "year", "mean", years)
    return reshape.unpivot_metrics(wide, ["month"], years, "year", "mean")


# ---------------------------------------------------------------------------
# Observed vs normal (A1 + J4 + R1)

_MONTHLY_NORMALS_CTE = """
, cy AS (SELECT station, max(year) AS cy FROM silver GROUP BY station),
mm AS (SELECT s.station, s.year, s.month, coalesce(sum(precip), 0.0) AS precip, coalesce(sum(snow), 0.0) AS snow,
             coalesce(sum(rain), 0.0) AS rain, avg(precip_day) AS precip_day
      FROM silver s JOIN cy USING (station) WHERE s.year BETWEEN cy.cy - 30 AND cy.cy - 1 GROUP BY 1, 2, 3),
mn AS (SELECT station, month, avg(precip) AS norm_precip, avg(snow) AS norm_snow, avg(rain) AS norm_rain,
       avg(precip_day) AS norm_precip_perc FROM mm GROUP BY 1, 2),
mnl AS (SELECT station, month, 'precip' AS metric_name, norm_precip AS normal FROM mn
        UNION ALL SELECT station, month, 'snow', norm_snow FROM mn
        UNION ALL SELECT station, month, 'rain', norm_rain FROM mn
        UNION ALL SELECT station, month, 'precip_perc', norm_precip_perc FROM mn)"""


@register("observed_vs_normal", with_fixtures("precip_silver") + _stack_sql("trailing") + _MONTHLY_NORMALS_CTE + """
, t AS (SELECT station, metric_name, month, year_for_dash, coalesce(sum(metric_value), 0.0) AS observed
        FROM long WHERE year_type = 'calendar_year' GROUP BY ALL),
jn AS (SELECT t.*, mnl.normal FROM t JOIN mnl USING (station, month, metric_name))
SELECT station, metric_name, month, year_for_dash, 'observed' AS type, observed AS metric_value FROM jn
UNION ALL SELECT station, metric_name, month, year_for_dash, 'normal', normal FROM jn""")
def q_observed_vs_normal(spark, sf_dir):
    """V13 (A1 + J4 + R1): monthly totals and the monthly normal per metric in long form (observed /
    normal)."""
    from climo.operators import normals
    from climo.plans import views
    s = fx.precip_silver(spark, sf_dir)
    return views.observed_vs_normal(s, normals.precip_monthly_normals(s))


@register("observed_vs_normal_current", ORACLE["observed_vs_normal"].replace(
    "WHERE year_type = 'calendar_year' GROUP BY ALL", "WHERE year_type = 'calendar_year' AND year_num = cy AND metric_name = 'precip' GROUP BY ALL"))
def q_observed_vs_normal_current(spark, sf_dir):
    """The current year's monthly precipitation and its normals, as the dashboard shows them."""
    from climo.operators import normals
    from climo.plans import views
    s = fx.precip_silver(spark, sf_dir)
    return views.observed_vs_normal(s, normals.precip_monthly_normals(s), metric="precip", current_year_only=True)


# ---------------------------------------------------------------------------
# V33 / U4 yearly trend table, V14/V15 departures, M8 linear trend

def _yearly_trend_sql() -> str:
    mtr = ORACLE["monthly_temp_rank"]
    mpr = ORACLE["monthly_precip_rank"]
    tym = ORACLE["temp_year_metrics"]
    return f"""WITH a AS ({mtr}),
b AS ({mpr}),
c AS ({tym}),
dtf AS ({with_fixtures('daily_temps')} SELECT * FROM daily_temps),
ym AS (SELECT station, CAST(year(date) AS INTEGER) AS year, avg(cloud_cover) AS cloud_cover, avg(pressure) AS pressure,
              avg(dew_point) AS dew_point, avg(wind_speed) AS wind_speed FROM dtf GROUP BY 1, 2),
dl AS (SELECT station, year, 'cloud_cover' AS metric_name, cloud_cover AS total FROM ym
       UNION ALL SELECT station, year, 'pressure', pressure FROM ym
       UNION ALL SELECT station, year, 'dew_point', dew_point FROM ym
       UNION ALL SELECT station, year, 'wind_speed', wind_speed FROM ym),
u AS (SELECT station, metric AS metric_name, year, mean AS total, rank FROM a WHERE month = 'Year'
      UNION ALL SELECT station, metric_name, CAST(year_for_dash AS INTEGER), total, rank FROM b
        WHERE month = 'Year' AND year_type = 'water_year'
      UNION ALL SELECT station, metric_name, year, total, rank FROM c
      UNION ALL SELECT station, metric_name, year, total,
        CASE WHEN total IS NOT NULL THEN
          CAST(rank() OVER (PARTITION BY station, metric_name ORDER BY total DESC NULLS LAST) AS INTEGER) END FROM dl),
yt AS (SELECT u.* FROM u JOIN (SELECT station, max(year) AS maxy FROM u GROUP BY 1) m USING (station)
       WHERE u.year <= m.maxy - 1)"""


@register("yearly_trend_table", _yearly_trend_sql() + "\nSELECT * FROM yt")
def q_yearly_trend_table(spark, sf_dir):
    """Sixteen yearly metrics (temperature means, water-year precipitation,
    yearly records, other means) in one ranked long table."""
    from climo.plans import views
    return views.yearly_trend_table(fx.daily_temps(spark, sf_dir), fx.precip_silver(spark, sf_dir),
                                    fx.HOT_THRESHOLD, fx.FREEZE_THRESHOLD)


@register("yearly_departure", _yearly_trend_sql() + """
, mx AS (SELECT station, max(year) AS maxy FROM yt GROUP BY 1),
f AS (SELECT yt.*, mx.maxy FROM yt JOIN mx USING (station) WHERE metric_name = 'max_temp' AND year >= 1996)
SELECT station, year, total, avg(total) OVER (PARTITION BY station) AS avg_line,
       total - avg(CASE WHEN year >= maxy - 30 THEN total END) OVER (PARTITION BY station) AS departure_from_normal
FROM f""")
def q_yearly_departure(spark, sf_dir):
    """One metric's yearly values with the shown-years mean and the
    departure from the trailing 30-year mean."""
    from climo.plans import views
    t = views.yearly_trend_table(fx.daily_temps(spark, sf_dir), fx.precip_silver(spark, sf_dir),
                                 fx.HOT_THRESHOLD, fx.FREEZE_THRESHOLD)
    return views.yearly_departure(t, "max_temp", 1996)


@register("linear_trend", _yearly_trend_sql() + """
, x AS (SELECT station, metric_name, CAST(year - min(year) OVER (PARTITION BY station, metric_name) AS DOUBLE) AS t,
          total FROM yt)
SELECT station, metric_name, (CASE WHEN isnan(regr_slope(total, t)) THEN NULL ELSE regr_slope(total, t) END) AS slope,
       (CASE WHEN isnan(regr_intercept(total, t)) THEN NULL ELSE regr_intercept(total, t) END) AS intercept, (CASE WHEN isnan(regr_r2(total, t)) THEN NULL ELSE regr_r2(total, t) END) AS r2,
       CAST(regr_count(total, t) AS BIGINT) AS n, (CASE WHEN isnan(regr_slope(total, t)) THEN NULL ELSE regr_slope(total, t) END) * 10 AS slope_per_decade
FROM x GROUP BY 1, 2""")
def q_linear_trend(spark, sf_dir):
    """M8: slope / intercept / r² of each yearly metric against years since start."""
    from climo.operators import regression as rg
    from climo.plans import views
    t = views.yearly_trend_table(fx.daily_temps(spark, sf_dir), fx.precip_silver(spark, sf_dir),
                                 fx.HOT_THRESHOLD, fx.FREEZE_THRESHOLD)
    return rg.linear_trend(t, "year", "total", keys=["station", "metric_name"], with_p=False)


def _num(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


_SLOPE_P_SQL = _yearly_trend_sql() + f"""
, sx AS (SELECT station, metric_name, CAST(year - min(year) OVER (PARTITION BY station, metric_name) AS DOUBLE) AS t, total FROM yt),
sg AS (SELECT station, metric_name, {_num("regr_slope(total, t)")} AS slope, {_num("regr_intercept(total, t)")} AS intercept,
        {_num("regr_r2(total, t)")} AS r2, CAST(regr_count(total, t) AS BIGINT) AS n, regr_sxx(total, t) AS sxx, regr_syy(total, t) AS syy
      FROM sx GROUP BY 1, 2),
se AS (SELECT *, n - 2 AS dof, CASE WHEN n > 2 AND sxx > 0 THEN sqrt(syy * (1 - coalesce(r2, 1.0::DOUBLE)) / (n - 2) / sxx) END AS se FROM sg),
th AS (SELECT *, CASE WHEN se > 0 THEN atan2(abs(slope / se), sqrt(dof)) END AS th FROM se),
sk AS (SELECT *, list_transform(range(0, dof // 2), lambda j: pow(cos(th), 2 * j)
        * coalesce(list_product(list_transform(range(1, j + 1), lambda i:
            CASE WHEN dof % 2 = 1 THEN 2.0::DOUBLE * i / (2 * i + 1) ELSE (2.0::DOUBLE * i - 1) / (2 * i) END)), 1)) AS terms FROM th),
sp AS (SELECT *, CASE WHEN dof % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum(terms), 0))
        ELSE 1 - sin(th) * list_sum(terms) END AS p FROM sk)
SELECT station, metric_name, slope, intercept, r2, n, slope * 10 AS slope_per_decade,
       CASE WHEN p IS NOT NULL THEN round(greatest(least(p, 1.0::DOUBLE), 0.0::DOUBLE), 12) END AS p_value FROM sp"""


@register("yearly_scatter_fit", _SLOPE_P_SQL)
def q_yearly_scatter_fit(spark, sf_dir):
    """Linear trend per yearly metric with the slope's p-value (t distribution)."""
    from climo.operators import regression as rg
    from climo.plans import views
    t = views.yearly_trend_table(fx.daily_temps(spark, sf_dir), fx.precip_silver(spark, sf_dir),
                                 fx.HOT_THRESHOLD, fx.FREEZE_THRESHOLD)
    return rg.linear_trend(t, "year", "total", keys=["station", "metric_name"], with_p=True)


# ---------------------------------------------------------------------------
# On this day (label → day index → histogram / bins / trend)

_LABEL = "Mar 01"
_LABEL_DOY = doy_sql("CAST(strptime('Mar 01 2024', '%b %d %Y') AS DATE)")


def _otd_hist_sql(src: str, metric: str, width: float) -> str:
    return f"""
, o AS (SELECT * FROM {src} WHERE {doy_sql('date')} = {_LABEL_DOY}),
b AS (SELECT station, floor(({metric} - 0.0) / {width}) * {width} + 0.0 AS bin_start, count(*) AS n
      FROM o WHERE {metric} IS NOT NULL GROUP BY 1, 2)
SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY station) AS percent FROM b"""


for _m, _w in (("min_temp", 25000.0), ("max_temp", 25000.0), ("cloud_cover", 10.0), ("dew_point", 25000.0)):
    def _mk(m=_m, w=_w):
        def q(spark, sf_dir):
            from climo.plans import views
            return views.on_this_day_histogram(fx.daily_temps(spark, sf_dir), _LABEL, m, w)
        q.__doc__ = f"V19-V22: on-this-day histogram (percent) of {m}."
        return q
    register(f"on_this_day_hist_{_m}", with_fixtures("daily_temps") + _otd_hist_sql("daily_temps", _m, _w))(_mk())


def _auto_hist_sql(metric: str) -> str:
    return f"""
, o AS (SELECT station, {metric} AS v FROM daily_temps WHERE {doy_sql('date')} = {_LABEL_DOY} AND {metric} IS NOT NULL),
s AS (SELECT station, count(*) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, max(v) - min(v) AS reach FROM o GROUP BY 1),
r AS (SELECT station, CASE WHEN iqr > 0 THEN 2.0::DOUBLE * iqr / cbrt(n) WHEN reach > 0 THEN reach / ceil(sqrt(n)) END AS raw FROM s),
u AS (SELECT station, raw, pow(10.0::DOUBLE, floor(log10(raw))) AS unit FROM r),
w AS (SELECT station, coalesce(unit * CASE WHEN raw / unit <= 1 THEN 1 WHEN raw / unit <= 2 THEN 2 WHEN raw / unit <= 5 THEN 5 ELSE 10 END,
        1.0::DOUBLE) AS bin_width FROM u),
b AS (SELECT station, bin_width, floor(v / bin_width) * bin_width AS bin_start, count(*) AS n FROM o JOIN w USING (station) GROUP BY 1, 2, 3)
SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY station) AS percent FROM b"""


for _m in ("min_temp", "max_temp", "dew_point"):
    def _mka(m=_m):
        def q(spark, sf_dir):
            from climo.plans import views
            return views.on_this_day_histogram(fx.daily_temps(spark, sf_dir), _LABEL, m, None)
        q.__doc__ = f"V19-V22 with automatic bins (A30): on-this-day histogram (percent) of {m}."
        return q
    register(f"on_this_day_auto_hist_{_m}", with_fixtures("daily_temps") + _auto_hist_sql(_m))(_mka())


def _step_sql(metric: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {metric} <= {e} THEN '{lab}'" for e, lab in zip(edges, labels))
    return f"CASE WHEN {metric} IS NULL THEN 'missing' {parts} ELSE '{labels[-1]}' END"


def _otd_bins(metric):
    from climo.plans import views
    return {"snow": (views.SNOW_BIN_EDGES, views.SNOW_BIN_LABELS),
            "rain": (views.RAIN_BIN_EDGES, views.RAIN_BIN_LABELS)}[metric]


for _m in ("snow", "rain"):
    _e, _l = _otd_bins(_m)

    def _mkb(m=_m, e=_e, lab=_l):
        def q(spark, sf_dir):
            from climo.plans import views
            return views.on_this_day_binned(fx.precip_silver(spark, sf_dir), _LABEL, m, e, lab)
        q.__doc__ = f"V23-V24: on-this-day {m} in labelled step bins (percent)."
        return q
    register(f"on_this_day_bins_{_m}", with_fixtures("precip_silver") + f"""
, o AS (SELECT * FROM silver WHERE day_of_year = {_LABEL_DOY}),
b AS (SELECT station, {_step_sql(_m, _e, _l)} AS bin, count(*) AS n FROM o GROUP BY 1, 2)
SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY station) AS percent FROM b""")(_mkb())


@register("on_this_day_trend_temps", with_fixtures("daily_temps") + f"""
SELECT station, CAST(year(date) AS INTEGER) AS year, min_temp, max_temp, cloud_cover FROM daily_temps
WHERE {doy_sql('date')} = {_LABEL_DOY}""")
def q_on_this_day_trend_temps(spark, sf_dir):
    """Low, high and cloud cover on one calendar day, by year."""
    from climo.plans import views
    return views.on_this_day_trend(fx.daily_temps(spark, sf_dir), _LABEL, ["min_temp", "max_temp", "cloud_cover"])


@register("on_this_day_trend_precip", with_fixtures("precip_silver") + f"""
SELECT station, CAST(year(date) AS INTEGER) AS year, rain, snow FROM silver WHERE day_of_year = {_LABEL_DOY}""")
def q_on_this_day_trend_precip(spark, sf_dir):
    """Rain and snow on one calendar day, by year."""
    from climo.plans import views
    return views.on_this_day_trend(fx.precip_silver(spark, sf_dir), _LABEL, ["rain", "snow"])


# ---------------------------------------------------------------------------
# Ingest operators

_AS_OF = "2001-06-01"


@register("null_watermark", with_fixtures("daily_precip_raw") + f"""
SELECT station, coalesce(min(CASE WHEN date >= DATE '{_AS_OF}' - INTERVAL 6 MONTH
                                   AND (tempmax IS NULL OR tempmin IS NULL OR precip IS NULL OR snow IS NULL)
                                  THEN date END), max(date)) AS start_date,
       CAST(DATE '{_AS_OF}' - INTERVAL 1 DAY AS DATE) AS end_date
FROM daily_precip_raw GROUP BY 1""")
def q_null_watermark(spark, sf_dir):
    """Per station, first date in the last 6 months with a missing needed field."""
    from climo.sources import ingest
    return ingest.null_watermark(fx.daily_precip_raw(spark, sf_dir), _AS_OF,
                                 fields=["tempmax", "tempmin", "precip", "snow"])


@register("next_range", with_fixtures("daily_precip_raw") + """
SELECT station, CAST(max(date) + INTERVAL 1 DAY AS DATE) AS start_date,
       CAST(datediff('day', CAST(max(date) + INTERVAL 1 DAY AS DATE), DATE '2002-01-01') AS INTEGER) AS days_to_update
FROM daily_precip_raw GROUP BY 1""")
def q_next_range(spark, sf_dir):
    """Resume date and number of days to fetch per station."""
    from climo.sources import ingest
    return ingest.next_range(fx.daily_precip_raw(spark, sf_dir), "2002-01-01")


@register("upsert_coalesce", with_fixtures("daily_precip_raw") + f"""
, ex AS (SELECT station, date, precip, snow, snow_depth, tempmin,
           CASE WHEN date >= DATE '{fx.INCREMENT_CUT}' - INTERVAL {fx.INCREMENT_OVERLAP_DAYS} DAY THEN NULL
                ELSE tempmax END AS tempmax
         FROM daily_precip_raw WHERE date < DATE '{fx.INCREMENT_CUT}'),
nw AS (SELECT station, date, precip, CASE WHEN date < DATE '{fx.INCREMENT_CUT}' THEN NULL ELSE snow END AS snow,
              tempmin, tempmax
       FROM daily_precip_raw WHERE date >= DATE '{fx.INCREMENT_CUT}' - INTERVAL {fx.INCREMENT_OVERLAP_DAYS} DAY)
SELECT coalesce(nw.station, ex.station) AS station, coalesce(nw.date, ex.date) AS date,
       coalesce(nw.precip, ex.precip) AS precip, coalesce(nw.snow, ex.snow) AS snow, ex.snow_depth AS snow_depth,
       coalesce(nw.tempmin, ex.tempmin) AS tempmin, coalesce(nw.tempmax, ex.tempmax) AS tempmax
FROM ex FULL OUTER JOIN nw ON ex.station = nw.station AND ex.date = nw.date""")
def q_upsert_coalesce(spark, sf_dir):
    """Merge an incremental batch: new values win, NULLs keep stored values."""
    from climo.sources import ingest
    existing, new = fx.incremental_batches(spark, sf_dir)
    return ingest.upsert_coalesce(existing, new)


def _landing_path(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid
    from climo.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/climo-landing/{uuid.uuid4().hex}/{name}"


@register("upsert_partitions", ORACLE["upsert_coalesce"])
def q_upsert_partitions(spark, sf_dir):
    """S10, partition-wise: the batch merged into a table stored by year and month; only its partitions are rewritten."""
    from climo.sources import ingest, landing
    existing, new = fx.incremental_batches(spark, sf_dir)
    parts = {"year": F.year("date"), "month": F.month("date")}
    path = _landing_path(spark, "daily")
    ingest.write_table(existing.withColumns(parts).repartition(*parts), path, partition_by=list(parts))
    landing.merge_partitions(new, path, parts)
    return spark.read.parquet(path).drop(*parts)


def _landed(spark, sf_dir, fmt: str):
    """The daily rows written as landing files, those of the 13th of a month with a broken date, and read back."""
    from pyspark.sql import types as T
    from climo.sources import landing
    raw = fx.daily_precip_raw(spark, sf_dir)
    broken = F.when(F.dayofmonth("date") == 13, F.lit("13th")).otherwise(F.col("date").cast("string"))
    path = _landing_path(spark, fmt)
    raw.withColumn("date", broken).write.format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
    return landing.read_landing(spark, path, T.StructType(raw.schema.fields), fmt), path


@register("landing_csv_round_trip", with_fixtures("daily_precip_raw") + "\nSELECT * FROM daily_precip_raw WHERE day(date) <> 13")
def q_landing_csv_round_trip(spark, sf_dir):
    """The clean rows of CSV landing files under an explicit schema."""
    return _landed(spark, sf_dir, "csv")[0].rows


@register("landing_json_round_trip", with_fixtures("daily_precip_raw") + "\nSELECT * FROM daily_precip_raw WHERE day(date) <> 13")
def q_landing_json_round_trip(spark, sf_dir):
    """The clean rows of JSON landing files under an explicit schema."""
    return _landed(spark, sf_dir, "json")[0].rows


@register("landing_quarantine", with_fixtures("daily_precip_raw") + """
SELECT station, count(*) AS n_records, 1::BIGINT AS n_folders FROM daily_precip_raw WHERE day(date) = 13 GROUP BY 1""")
def q_landing_quarantine(spark, sf_dir):
    """Records that don't fit the schema, kept whole in the quarantine table with the file they came from."""
    from climo.sources import landing
    landed, path = _landed(spark, sf_dir, "csv")
    kept = landing.quarantined(landed, path + "_quarantine")
    folder = F.regexp_extract("source_file", "^(.*)/", 1)
    return (kept.groupBy(F.split("record", ",")[0].alias("station"))
            .agg(F.count("*").alias("n_records"), F.countDistinct(folder).alias("n_folders")))


@register("key_violations", with_fixtures("precip_silver") + """
SELECT (SELECT count(*) FROM (SELECT station, date FROM silver GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_keys,
       (SELECT CAST(count_if(station IS NULL OR date IS NULL) AS BIGINT) FROM silver) AS null_keys""")
def q_key_violations(spark, sf_dir):
    """Duplicate and NULL (station, date) keys of the silver table."""
    from climo.sources import ingest
    return ingest.key_violations(fx.precip_silver(spark, sf_dir))


_RAW_COLS = ["station", "date", "precip", "snow", "snow_depth", "tempmin", "tempmax"]


@register("null_profile", with_fixtures("daily_precip_raw") + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS pct_null "
    f"FROM daily_precip_raw" for c in _RAW_COLS))
def q_null_profile(spark, sf_dir):
    """Percent NULL per column."""
    from climo.sources import ingest
    return ingest.null_profile(fx.daily_precip_raw(spark, sf_dir))


# ---------------------------------------------------------------------------
# Regression family (M4-M14, A17, A36) — rows-only checks, goldens in tests

@register("daily_normals")
def q_daily_normals(spark, sf_dir):
    """M4-M6: spline-smoothed daily normals (high df 7, low df 6, mean df 5) and
    smoothed p10/p90 bands (df 6), 366 rows per station."""
    from climo.operators import regression as rg
    return rg.daily_normals(fx.daily_temps(spark, sf_dir), _NORMAL_YEARS)


@register("normal_month_means")
def q_normal_month_means(spark, sf_dir):
    """Monthly means of the daily normal curves (1 dp, half-even)."""
    from climo.operators import normals
    from climo.operators import regression as rg
    dn = rg.daily_normals(fx.daily_temps(spark, sf_dir), _NORMAL_YEARS, dp=None)
    return normals.normal_month_means(dn, ["normal_high", "normal_low", "normal_temp"])


@register("smoothed_bands")
def q_smoothed_bands(spark, sf_dir):
    """M5: per-station p10/p90 of daily highs by day of year, spline-smoothed."""
    from climo.operators import regression as rg
    d = fx.daily_temps(spark, sf_dir).withColumn("day_of_year", cal.doy_index("date"))
    return rg.smoothed_bands(d, "max_temp", (0.1, 0.9), 6)


@register("cv_select_df")
def q_cv_select_df(spark, sf_dir):
    """M7: leave-one-year-out CV error of the daily-high curve for df 2..24."""
    from climo.operators import regression as rg
    return rg.cv_select_df(fx.daily_temps(spark, sf_dir), "max_temp", _NORMAL_YEARS)


def _seasonal_frame(spark, sf_dir):
    from climo.operators import reshape
    d = fx.daily_temps(spark, sf_dir).select("station", "date", "avg_temp")
    d = reshape.attach_scalars(d, reshape.per_key_scalars(d, ["station"], _d0=F.min("date")), ["station"])
    return d.withColumns({"doy_frac": cal.fraction_of_year("date"),
                          "total_years": cal.days_since("date", "_d0") / 365.25}).drop("_d0")


def _trend_terms():
    from climo.operators import regression as rg
    return [rg.intercept(), rg.linear("total_years"), rg.cc("doy_frac", 12)]


@register("seasonal_trend_model")
def q_seasonal_trend_model(spark, sf_dir):
    """M10 + M14: avg_temp ~ 1 + total_years + cc(doy_frac, 12) per station;
    fitted value, its intercept / trend / seasonal components, residual and
    the 365-row rolling residual mean (≥ 180 values)."""
    from climo.operators import least_squares as ls
    from climo.operators import windows
    d, terms = _seasonal_frame(spark, sf_dir), _trend_terms()
    p = ls.predict(d, ls.ols_fit(d, "avg_temp", terms, part=F.year("date")), terms, components=True)
    p = p.withColumnsRenamed({"comp_Intercept": "intercept_effect", "comp_total_years": "trend_effect",
                              "comp_cc(doy_frac)": "seasonal_effect"})
    p = p.withColumn("residual", F.col("avg_temp") - F.col("fitted"))
    return windows.rolling_mean(p, "residual", 365, 180)


@register("spline_trend_model")
def q_spline_trend_model(spark, sf_dir):
    """M2 + M10: avg_temp ~ 1 + cr(total_years, 3) + cc(doy_frac, 12): fitted values and residuals."""
    from climo.operators import least_squares as ls
    from climo.operators import regression as rg
    d = _seasonal_frame(spark, sf_dir)
    terms = [rg.intercept(), rg.cr("total_years", 3), rg.cc("doy_frac", 12)]
    p = ls.predict(d, ls.ols_fit(d, "avg_temp", terms, part=F.year("date")), terms)
    return p.withColumn("residual", F.col("avg_temp") - F.col("fitted"))


@register("trend_effect_by_year")
def q_trend_effect_by_year(spark, sf_dir):
    """Mean fitted trend component per year."""
    from climo.operators import least_squares as ls
    d, terms = _seasonal_frame(spark, sf_dir), _trend_terms()
    p = ls.predict(d, ls.ols_fit(d, "avg_temp", terms, part=F.year("date")), terms, components=True)
    return (p.groupBy("station", F.year("date").alias("year"))
            .agg(F.avg(F.col("comp_Intercept") + F.col("comp_total_years")).alias("trend_effect")))


def _hourly_model_frame(spark, sf_dir):
    h = fx.hourly(spark, sf_dir).select("station", "timestamp", "temp")
    t0 = h.groupBy("station").agg(F.min("timestamp").alias("_t0"))
    h = h.join(t0, "station")
    ti = cal.days_since("timestamp", "_t0")
    return h.select("station", "timestamp", "temp", ti.alias("time_index"),
                    F.pmod(ti, F.lit(365.25)).alias("year_index"), F.hour("timestamp").cast("double").alias("hourly_index"),
                    cal.month_label("timestamp").alias("month"))


def _hourly_terms():
    """116 columns, always: a month that a station hasn't seen has null coefficients."""
    from climo.operators import regression as rg
    return [rg.intercept(), rg.linear("time_index"), rg.cc("year_index", 6, upper=365.25),
            rg.cc_by("month", cal.MONTH_LABELS, "hourly_index", 9, upper=24.0)]


def _hourly_fit(h):
    from climo.operators import least_squares as ls
    return ls.ols_fit(h, "temp", _hourly_terms(), part=F.year("timestamp"))


@register("hourly_model_decomposition")
def q_hourly_model_decomposition(spark, sf_dir):
    """M11 + M12: temp ~ 1 + t + cc(year_index, 6) + month:cc(hour, 9) per
    station; fitted values and the additive trend / yearly / hourly parts."""
    from climo.operators import least_squares as ls
    h = _hourly_model_frame(spark, sf_dir)
    p = ls.predict(h, _hourly_fit(h), _hourly_terms(), components=True)
    return p.withColumnsRenamed({"comp_Intercept": "intercept", "comp_time_index": "time_trend",
                                 "comp_cc(year_index)": "year_seasonality",
                                 "comp_month:cc(hourly_index)": "hourly_seasonality"})


@register("hourly_effects")
def q_hourly_effects(spark, sf_dir):
    """Mean hourly component by month × hour; hottest and coldest hour per month."""
    d = q_hourly_model_decomposition(spark, sf_dir)
    eff = (d.withColumn("hour", F.hour("timestamp"))
           .groupBy("station", "month", "hour").agg(F.avg("hourly_seasonality").alias("hourly_seasonality")))
    # hottest and coldest hour from one aggregate (W15 twice), earliest hour on ties
    row = F.struct("hour", "hourly_seasonality")
    picked = (eff.groupBy("station", "month")
              .agg(F.max_by(row, F.struct(F.col("hourly_seasonality"), F.negative("hour"))).alias("hottest"),
                   F.min_by(row, F.struct(F.col("hourly_seasonality"), F.col("hour"))).alias("coldest")))
    both = F.array(F.struct(F.lit("hottest").alias("kind"), F.col("hottest").alias("r")),
                   F.struct(F.lit("coldest").alias("kind"), F.col("coldest").alias("r")))
    return (picked.select("station", "month", F.explode(both).alias("_e"))
            .select("station", "month", "_e.r.hour", "_e.r.hourly_seasonality", "_e.kind"))


@register("hourly_model_coefficients")
def q_hourly_model_coefficients(spark, sf_dir):
    """Per-station coefficients, standard errors and p-values of the hourly model (116 columns)."""
    return _hourly_fit(_hourly_model_frame(spark, sf_dir)).drop("pieces", "constants")


@register("trend_plus_month_effects")
def q_trend_plus_month_effects(spark, sf_dir):
    """M9: monthly precipitation ~ 1 + month + t (treatment coding, t = months
    since start) per station; coefficients with p-values."""
    from climo.operators import least_squares as ls
    from climo.operators import regression as rg
    s = fx.precip_silver(spark, sf_dir)
    m = (s.groupBy("station", "year", F.month("date").alias("month_num"), "month")
         .agg(F.coalesce(F.sum("precip"), F.lit(0.0)).alias("precip")))
    number = F.col("year") * 12 + F.col("month_num")
    m = m.where("station is not null").withColumn("t", (number - F.min(number).over(Window.partitionBy("station"))).cast("double"))
    terms = [rg.intercept(), rg.dummies("month", cal.MONTH_LABELS), rg.linear("t")]
    return ls.ols_fit(m, "precip", terms, part=F.lit(0.0)).drop("pieces", "constants")


# ---------------------------------------------------------------------------
# J2, J3/F17, A34, R3, J5/F11 (V8), V10, V11, V18 (months)

@register("temps_with_bands", with_fixtures("daily_temps") + f"""
, d AS (SELECT *, {doy_sql('date')} AS day_of_year FROM daily_temps),
b AS (SELECT station, day_of_year, quantile_cont(max_temp, 0.1) AS max_temp_p10, quantile_cont(max_temp, 0.9) AS max_temp_p90,
             quantile_cont(min_temp, 0.1) AS min_temp_p10, quantile_cont(min_temp, 0.9) AS min_temp_p90
      FROM d WHERE year(date) BETWEEN {fx.NORMAL_START} AND {fx.NORMAL_END} GROUP BY 1, 2)
SELECT d.station, d.date, d.day_of_year, d.max_temp, d.min_temp, b.max_temp_p10, b.max_temp_p90, b.min_temp_p10,
       b.min_temp_p90 FROM d LEFT JOIN b ON d.station = b.station AND d.day_of_year = b.day_of_year""")
def q_temps_with_bands(spark, sf_dir):
    """Days ⟕ their day-of-year p10/p90 bands of highs and lows."""
    from climo.plans import views
    return views.temps_with_bands(fx.daily_temps(spark, sf_dir), _NORMAL_YEARS)


@register("monthly_precip_anomaly", with_fixtures("precip_silver") + _MONTHLY_NORMALS_CTE + """
, t AS (SELECT station, year, month, coalesce(sum(precip), 0.0) AS precip, coalesce(sum(snow), 0.0) AS snow,
          coalesce(sum(rain), 0.0) AS rain FROM silver GROUP BY 1, 2, 3)
SELECT t.station, t.year, t.month, t.precip, t.snow, t.rain, t.precip - mn.norm_precip AS precip_anomaly,
       t.snow - mn.norm_snow AS snow_anomaly, t.rain - mn.norm_rain AS rain_anomaly,
       CASE WHEN mn.norm_precip <> 0 THEN 100.0 * (t.precip / mn.norm_precip - 1.0) END AS precip_anomaly_perc
FROM t LEFT JOIN mn ON t.station = mn.station AND t.month = mn.month""")
def q_monthly_precip_anomaly(spark, sf_dir):
    """J3 + F17: monthly totals against the monthly normals."""
    from climo.operators import normals
    from climo.plans import views
    s = fx.precip_silver(spark, sf_dir)
    return views.monthly_precip_anomaly(s, normals.precip_monthly_normals(s))


@register("monthly_adhoc_summary", with_fixtures("daily_precip_raw") + """
SELECT station, CAST(year(date) AS INTEGER) AS year, strftime(date, '%b') AS month, max(tempmax) AS tempmax,
       min(tempmin) AS tempmin, avg((tempmax + tempmin) / 2) AS tempavg, coalesce(sum(precip), 0.0) AS precip,
       coalesce(sum(snow), 0.0) AS snow, max(snow_depth) AS snow_depth FROM daily_precip_raw GROUP BY 1, 2, 3""")
def q_monthly_adhoc_summary(spark, sf_dir):
    """Per (year, month) max high, min low, mean temperature, total precipitation and snow, max depth."""
    from climo.operators import aggregates as agg
    r = fx.daily_precip_raw(spark, sf_dir)
    return (r.groupBy("station", F.year("date").alias("year"), cal.month_label("date").alias("month"))
            .agg(F.max("tempmax").alias("tempmax"), F.min("tempmin").alias("tempmin"),
                 F.avg((F.col("tempmax") + F.col("tempmin")) / 2).alias("tempavg"),
                 agg._sum0("precip").alias("precip"), agg._sum0("snow").alias("snow"),
                 F.max("snow_depth").alias("snow_depth")))


_SECTORS = [i * 22.5 for i in range(16)]


@register("wind_rose_complete", ORACLE["wind_rose"].replace(
    "SELECT *, frequency / sum(frequency) OVER (PARTITION BY station) AS share FROM c",
    ", s AS (SELECT *, frequency / sum(frequency) OVER (PARTITION BY station) AS share FROM c),\n"
    "g AS (SELECT station, sp AS wind_speed_cat, dr AS wind_direction_cat FROM (SELECT DISTINCT station FROM s)\n"
    "      CROSS JOIN (SELECT unnest(['0-10', '10-15', '15-20', '20-30', '30-40', '40+']) AS sp)\n"
    "      CROSS JOIN (SELECT CAST(unnest([" + ", ".join(str(x) for x in _SECTORS) + "]) AS DOUBLE) AS dr))\n"
    "SELECT g.station, g.wind_speed_cat, g.wind_direction_cat, coalesce(s.frequency, 0) AS frequency,\n"
    "       coalesce(s.share, 0.0) AS share FROM g LEFT JOIN s ON g.station = s.station\n"
    "  AND g.wind_speed_cat = s.wind_speed_cat AND g.wind_direction_cat = s.wind_direction_cat"))
def q_wind_rose_complete(spark, sf_dir):
    """R3 + A28: wind rose with every speed bin × sector combination (zero-filled)."""
    from climo.functions import derive as dv
    from climo.operators import aggregates as agg
    from climo.operators import reshape
    wr = agg.wind_rose(fx.wind(spark, sf_dir))
    return reshape.complete_categories(wr, ["station"], {"wind_speed_cat": dv.WIND_SPEED_LABELS,
                                                         "wind_direction_cat": _SECTORS},
                                       {"frequency": 0, "share": 0.0})


@register("wind_rose_months", ORACLE["wind_rose"].replace(
    "FROM wind w JOIN mx USING (station)),", "FROM wind w JOIN mx USING (station)\n"
    "      WHERE strftime(w.date, '%b') IN ('Jan', 'Feb', 'Dec')),"))
def q_wind_rose_months(spark, sf_dir):
    """V18 + P6: wind rose over selected months (IN-list filter)."""
    from climo.operators import aggregates as agg
    return agg.wind_rose(fx.wind(spark, sf_dir), months=["Jan", "Feb", "Dec"])


@register("hourly_with_sun", with_fixtures("hourly", "sun_times") + """
SELECT h.station, h.timestamp, CAST(h.timestamp AS DATE) AS day, h.temp, s.sunrise, s.sunset,
  CAST(split_part(split_part(s.sunrise, 'T', 2), ':', 1) AS INTEGER)
    + CAST(split_part(split_part(s.sunrise, 'T', 2), ':', 2) AS INTEGER) / 60.0 AS sunrise_hr,
  CAST(split_part(split_part(s.sunset, 'T', 2), ':', 1) AS INTEGER)
    + CAST(split_part(split_part(s.sunset, 'T', 2), ':', 2) AS INTEGER) / 60.0 AS sunset_hr
FROM hourly h LEFT JOIN sun_times s ON h.station = s.station AND CAST(h.timestamp AS DATE) = s.day""")
def q_hourly_with_sun(spark, sf_dir):
    """J5 + F11: hourly rows with their day's sunrise / sunset as decimal hours."""
    from climo.plans import views
    return views.hourly_with_sun(fx.hourly(spark, sf_dir), fx.sun_times(spark, sf_dir))


@register("ytd_view", with_fixtures("precip_silver") + _stack_sql("trailing") + """
SELECT station, date, year_for_dash, is_current, day_of_year_dash,
       sum(coalesce(CAST(precip AS DOUBLE), 0.0)) OVER (PARTITION BY station, year_for_dash
         ORDER BY day_of_year_dash, date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS year_to_date,
       strftime(date, '%b %d') AS dashboard_date
FROM stk WHERE year_type = 'water_year'""")
def q_ytd_view(spark, sf_dir):
    """Water-year-to-date precipitation for every year (current flagged)."""
    from climo.plans import views
    return views.ytd_view(fx.precip_silver(spark, sf_dir), "water_year", "precip")


@register("ytd_chart", with_fixtures("precip_silver") + _stack_sql("trailing") + f"""
, yn AS ({ORACLE["ytd_normals"]}),
ln AS (SELECT station, day_of_year_dash, avg_precip_ytd AS normal_ytd, CASE WHEN dashboard_date LIKE '%01' THEN dashboard_date END AS month_tick
       FROM yn WHERE year_type = 'water_year' AND metric_name = 'precip'),
v AS (SELECT station, date, year_for_dash, is_current, day_of_year_dash,
       sum(coalesce(CAST(precip AS DOUBLE), 0.0)) OVER (PARTITION BY station, year_for_dash
         ORDER BY day_of_year_dash, date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS year_to_date,
       strftime(date, '%b %d') AS dashboard_date
     FROM stk WHERE year_type = 'water_year')
SELECT v.*, normal_ytd, month_tick FROM v LEFT JOIN ln USING (station, day_of_year_dash)""")
def q_ytd_chart(spark, sf_dir):
    """Water-year-to-date precipitation of every year with the normals line and the month ticks."""
    from climo.operators import normals
    from climo.plans import views
    s = fx.precip_silver(spark, sf_dir)
    return views.ytd_chart(s, normals.ytd_normals(s, metrics=["precip"]), "water_year", "precip")


@register("mtd_view", with_fixtures("precip_silver") + _stack_sql("trailing") + f"""
, mx AS (SELECT station, max(date) AS mx FROM silver GROUP BY 1),
cur AS (SELECT s.station, s.month, dayofmonth(s.date) AS day_of_month,
          sum(coalesce(CAST(s.precip AS DOUBLE), 0.0)) OVER (PARTITION BY s.station, s.month ORDER BY s.date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS month_to_date
        FROM stk s JOIN mx USING (station)
        WHERE s.year_type = 'calendar_year' AND s.is_current AND date_trunc('month', s.date) = date_trunc('month', mx.mx)),
c AS (SELECT *, dayofmonth(date) AS day_of_month,
          sum(coalesce(metric_value, 0.0)) OVER (PARTITION BY station, metric_name, year_for_dash, month
            ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mtd
        FROM long WHERE year_type = 'calendar_year' AND metric_name = 'precip'),
n AS (SELECT station, month, day_of_month, avg(CASE WHEN norm_range THEN mtd END) AS avg_precip_mtd,
        min(mtd) AS min_precip_mtd, max(mtd) AS max_precip_mtd,
        {_pct_cols('CASE WHEN norm_range THEN mtd END', 'precip_mtd')}
      FROM c WHERE NOT is_current GROUP BY 1, 2, 3)
SELECT cur.station, cur.month, CAST(cur.day_of_month AS INTEGER) AS day_of_month, cur.month_to_date,
       n.avg_precip_mtd, n.min_precip_mtd, n.max_precip_mtd, n.p10_precip_mtd, n.p25_precip_mtd, n.p50_precip_mtd,
       n.p75_precip_mtd, n.p90_precip_mtd
FROM cur JOIN n ON cur.station = n.station AND cur.month = n.month AND cur.day_of_month = n.day_of_month
WHERE n.avg_precip_mtd IS NOT NULL AND n.p10_precip_mtd IS NOT NULL AND n.min_precip_mtd IS NOT NULL""")
def q_mtd_view(spark, sf_dir):
    """Current month's running precipitation against month-to-date normals."""
    from climo.plans import views
    return views.mtd_view(fx.precip_silver(spark, sf_dir), "precip")


# ---------------------------------------------------------------------------
# A6, A7, A11, A21 (snow) as standalone queries

@register("doy_means", with_fixtures("daily_temps") + f"""
SELECT station, {doy_sql('date')} AS day_of_year, avg(max_temp) AS max_temp, avg(min_temp) AS min_temp,
       avg(avg_temp) AS avg_temp FROM daily_temps WHERE year(date) BETWEEN {fx.NORMAL_START} AND {fx.NORMAL_END}
GROUP BY 1, 2""")
def q_doy_means(spark, sf_dir):
    """Mean high / low / average by day of year over the normals years."""
    from climo.operators import normals
    d = fx.daily_temps(spark, sf_dir).withColumn("day_of_year", cal.doy_index("date"))
    return normals.doy_means(d, ["max_temp", "min_temp", "avg_temp"], year_range=_NORMAL_YEARS)


@register("doy_percentile_bands", with_fixtures("daily_temps") + f"""
SELECT station, {doy_sql('date')} AS day_of_year, quantile_cont(max_temp, 0.1) AS max_temp_p10,
       quantile_cont(max_temp, 0.9) AS max_temp_p90 FROM daily_temps
WHERE year(date) BETWEEN {fx.NORMAL_START} AND {fx.NORMAL_END} GROUP BY 1, 2""")
def q_doy_percentile_bands(spark, sf_dir):
    """Exact p10 / p90 of highs by day of year."""
    from climo.operators import normals
    d = fx.daily_temps(spark, sf_dir).withColumn("day_of_year", cal.doy_index("date"))
    return normals.doy_percentile_bands(d, "max_temp", (0.1, 0.9), year_range=_NORMAL_YEARS)


@register("incomplete_years", with_fixtures("precip_silver") + _stack_sql("decade") + """
SELECT station, year_type, year_for_dash FROM stk GROUP BY ALL HAVING min(day_of_year_dash) <> 1""")
def q_incomplete_years(spark, sf_dir):
    """(station, calendar, year) whose first day index is not 1."""
    from climo.operators import normals
    return normals.incomplete_years(normals.precip_stacked(fx.precip_silver(spark, sf_dir)))


@register("snow_date_percentiles", with_fixtures("precip_silver")
          + _season_events_sql("silver", "snow > 0", "snow")
          + "\n" + _event_pct_sql("first_snow_doy", "first_snow")
          + "\nUNION ALL " + _event_pct_sql("last_snow_doy", "last_snow"))
def q_snow_date_percentiles(spark, sf_dir):
    """Quantiles of first / last snow index as calendar labels."""
    from climo.operators import aggregates as agg
    sd = agg.season_event_dates(fx.precip_silver(spark, sf_dir), F.col("snow") > 0, prefix="snow")
    return (agg.event_date_percentiles(sd, "first_snow_doy", "first_snow")
            .unionByName(agg.event_date_percentiles(sd, "last_snow_doy", "last_snow")))


@register("hourly_density", with_fixtures("hourly") + """
, f AS (SELECT *, max(year(timestamp)) OVER (PARTITION BY station) AS last_y FROM hourly),
b AS (SELECT station,
        CASE WHEN temp < 0 THEN 0 WHEN temp >= 100 THEN 101 ELSE CAST(floor((temp - 0.0) / 1.0) AS BIGINT) + 1 END AS x_bin,
        CASE WHEN dew_point < 0 THEN 0 WHEN dew_point >= 100 THEN 101
             ELSE CAST(floor((dew_point - 0.0) / 1.0) AS BIGINT) + 1 END AS y_bin
      FROM f WHERE temp IS NOT NULL AND dew_point IS NOT NULL AND year(timestamp) BETWEEN last_y - 29 AND last_y
        AND strftime(timestamp, '%b') IN ('Dec', 'Jan', 'Feb')),
c AS (SELECT station, x_bin, y_bin, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT station, x_bin, y_bin, CAST(sum(n) AS BIGINT) AS n, CAST(grouping(x_bin, y_bin) AS INTEGER) AS level FROM c
GROUP BY GROUPING SETS ((station, x_bin, y_bin), (station, x_bin), (station, y_bin))""")
def q_hourly_density(spark, sf_dir):
    """V9: per-station temp × dew point density for winter months over the last 30 years."""
    from climo.plans import views
    return views.hourly_density(fx.hourly(spark, sf_dir), "temp", "dew_point", ["Dec", "Jan", "Feb"],
                                (0.0, 100.0), (0.0, 100.0), exclude_last_year=False)


@register("hourly_density_past_years", with_fixtures("daily_temps") + """
, f AS (SELECT *, max(year(date)) OVER (PARTITION BY station) AS last_y FROM daily_temps),
b AS (SELECT station,
        CASE WHEN min_temp < 0 THEN 0 WHEN min_temp >= 500000 THEN 101 ELSE CAST(floor(min_temp / 5000.0::DOUBLE) AS BIGINT) + 1 END AS x_bin,
        CASE WHEN max_temp < 0 THEN 0 WHEN max_temp >= 500000 THEN 101 ELSE CAST(floor(max_temp / 5000.0::DOUBLE) AS BIGINT) + 1 END AS y_bin
      FROM f WHERE min_temp IS NOT NULL AND max_temp IS NOT NULL AND year(date) BETWEEN last_y - 30 AND last_y - 1
        AND strftime(date, '%b') IN ('Dec', 'Jan', 'Feb')),
c AS (SELECT station, x_bin, y_bin, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT station, x_bin, y_bin, CAST(sum(n) AS BIGINT) AS n, CAST(grouping(x_bin, y_bin) AS INTEGER) AS level FROM c
GROUP BY GROUPING SETS ((station, x_bin, y_bin), (station, x_bin), (station, y_bin))""")
def q_hourly_density_past_years(spark, sf_dir):
    """V9 with its own window: the 30 years before each station's latest one (the daily table stands in: it has several years)."""
    from climo.plans import views
    d = fx.daily_temps(spark, sf_dir).withColumn("timestamp", F.col("date").cast("timestamp_ntz"))
    return views.hourly_density(d, "min_temp", "max_temp", ["Dec", "Jan", "Feb"], (0.0, 500_000.0), (0.0, 500_000.0))


@register("sun_lines", with_fixtures("sun_times") + f"""
SELECT station, {doy_sql('day')} AS day_of_year,
  CAST(split_part(split_part(sunrise, 'T', 2), ':', 1) AS INTEGER)
    + CAST(split_part(split_part(sunrise, 'T', 2), ':', 2) AS INTEGER) / 60.0 AS sunrise_hr,
  CAST(split_part(split_part(sunset, 'T', 2), ':', 1) AS INTEGER)
    + CAST(split_part(split_part(sunset, 'T', 2), ':', 2) AS INTEGER) / 60.0 AS sunset_hr
FROM sun_times WHERE year(day) = 2024""")
def q_sun_lines(spark, sf_dir):
    """V8: sunrise / sunset decimal-hour lines of one year for the hourly heatmap."""
    from climo.plans import views
    return views.sun_lines(fx.sun_times(spark, sf_dir), 2024)
