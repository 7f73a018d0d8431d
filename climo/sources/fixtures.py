"""Stand-in observation tables derived from the driver's test tables.

These only reshape rows into the schemas the operators expect (see
FIXTURES.md §3); they do none of the operators' work.  Each builder has a
DuckDB SQL twin in ``FIXTURE_SQL`` used by the oracle queries.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from climo.sources.ingest import build_precip_silver

# Parameters fitted to the fixture value ranges (o_totalprice ~1e3..5e5,
# discount*1000 in 0..100, quantities 1..50).
HOT_THRESHOLD = 450_000.0      # "100 degree" day on the price scale
FREEZE_THRESHOLD = 50_000.0    # "32 degree" day on the price scale
NORMAL_START, NORMAL_END = 1996, 2000
INCREMENT_CUT = "2000-01-01"
INCREMENT_OVERLAP_DAYS = 30
#: Fact rows per partition: tasks stay of one size, however large the table.
PARTITION_ROWS = 100_000
MIN_PARTITIONS = 8


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def daily_temps(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """daily_temps(station, date, avg/min/max_temp, dew_point, cloud_cover, pressure, wind_speed)."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    if dense:
        base = o.withColumn("station", F.lit("ALL"))
    else:
        c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        base = (o.join(c, o.o_custkey == c.c_custkey)
                .withColumn("station", F.col("c_nationkey").cast("string")))
    p = F.col("o_totalprice")
    return (base.groupBy("station", F.to_date("o_orderdate").alias("date"))
            .agg(F.avg(p).alias("avg_temp"), F.min(p).alias("min_temp"), F.max(p).alias("max_temp"),
                 F.avg(F.when(F.col("o_orderstatus") == "F", p)).alias("dew_point"),
                 (F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)) * 100).alias("cloud_cover"),
                 F.count(F.lit(1)).cast("double").alias("pressure"),
                 (F.max(p) / 10000.0).alias("wind_speed")))


def daily_precip_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_precip_raw(station, date, precip, snow, snow_depth, tempmin, tempmax).

    The facts are dealt by (station, date) before they are summed, so a task's hash tables don't grow with the table, and the
    days by station, so that what operators group, rank or sum up per station needs no further exchange."""
    li = _read(spark, sf_dir, "lineitem")
    parts = max(-(-li.count() // PARTITION_ROWS), MIN_PARTITIONS)
    li = li.select(F.col("l_suppkey").cast("string").alias("station"), F.to_date("l_shipdate").alias("date"),
                   "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    q = F.col("l_quantity")
    return (li.repartition(parts, "station", "date").groupBy("station", "date")
            .agg(F.sum(q).alias("precip"),
                 F.sum(F.when(F.col("l_returnflag") == "R", q)).alias("snow"),
                 F.sum(F.when(F.col("l_linestatus") == "O", q)).alias("snow_depth"),
                 (F.min("l_discount") * 1000).alias("tempmin"),
                 (F.max("l_discount") * 1000).alias("tempmax"))
            .repartition(parts, "station"))


def precip_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver table: ``build_precip_silver`` (S12) over the raw table."""
    return build_precip_silver(daily_precip_raw(spark, sf_dir))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hourly(station, timestamp, temp, humidity, dew_point, precip, rain, snow, cloud_cover, wind_speed, pressure)."""
    e = _read(spark, sf_dir, "events").select("event_type", "ts", "value", "props")
    v = F.col("value")
    k = F.get_json_object("props", "$.k").cast("double")
    return (e.groupBy(F.col("event_type").alias("station"),
                      F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"))
            .agg(F.avg(v).alias("temp"), F.max(v).alias("humidity"), F.min(v).alias("dew_point"),
                 (F.sum(F.when(v < 5, v)) / 10.0).alias("precip"),
                 (F.sum(F.when(v < 3, v)) / 10.0).alias("rain"),
                 (F.sum(F.when((v >= 3) & (v < 5), v)) / 10.0).alias("snow"),
                 F.avg(k).alias("cloud_cover"),
                 F.stddev_samp(v).alias("wind_speed"),
                 F.count(F.lit(1)).cast("double").alias("pressure")))


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wind(station, date, wind_speed, wind_direction)."""
    e = _read(spark, sf_dir, "events").select("event_type", "ts", "value", "props")
    return e.select(F.col("event_type").alias("station"), F.to_date("ts").alias("date"),
                    F.col("value").alias("wind_speed"),
                    (F.get_json_object("props", "$.k").cast("double") * 3.6).alias("wind_direction"))


def sun_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sun_times(station, day, sunrise, sunset) with ``yyyy-MM-ddTHH:mm`` strings:
    first and last event of each (type, day)."""
    e = _read(spark, sf_dir, "events").select("event_type", "ts")
    fmt = "yyyy-MM-dd'T'HH:mm"
    return (e.groupBy(F.col("event_type").alias("station"), F.to_date("ts").alias("day"))
            .agg(F.date_format(F.min("ts"), fmt).alias("sunrise"), F.date_format(F.max("ts"), fmt).alias("sunset")))


def category_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("r_name").alias("continent"), F.col("c_acctbal").alias("measure")))


def incremental_batches(spark: SparkSession, sf_dir: str):
    """(existing, new) for the upsert: existing = rows before the cut with
    ``tempmax`` blanked in the overlap window; new = rows from cut-overlap on,
    with ``snow`` blanked in the overlap and ``snow_depth`` absent."""
    raw = daily_precip_raw(spark, sf_dir)
    cut = F.lit(INCREMENT_CUT).cast("date")
    start = F.date_sub(cut, INCREMENT_OVERLAP_DAYS)
    existing = (raw.filter(F.col("date") < cut)
                .withColumn("tempmax", F.when(F.col("date") >= start, F.lit(None).cast("double"))
                            .otherwise(F.col("tempmax"))))
    new = (raw.filter(F.col("date") >= start).drop("snow_depth")
           .withColumn("snow", F.when(F.col("date") < cut, F.lit(None).cast("double"))
                       .otherwise(F.col("snow"))))
    return existing, new


# ---- DuckDB twins ----------------------------------------------------------

FIXTURE_SQL = {
    "daily_temps": """
daily_temps AS (
  SELECT CAST(c.c_nationkey AS VARCHAR) AS station, CAST(o.o_orderdate AS DATE) AS date,
         avg(o.o_totalprice) AS avg_temp, min(o.o_totalprice) AS min_temp, max(o.o_totalprice) AS max_temp,
         avg(CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice END) AS dew_point,
         avg(CASE WHEN o.o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) * 100 AS cloud_cover,
         CAST(count(*) AS DOUBLE) AS pressure,
         max(o.o_totalprice) / 10000.0 AS wind_speed
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2)""",
    "daily_temps_dense": """
daily_temps_dense AS (
  SELECT 'ALL' AS station, CAST(o.o_orderdate AS DATE) AS date,
         avg(o.o_totalprice) AS avg_temp, min(o.o_totalprice) AS min_temp, max(o.o_totalprice) AS max_temp
  FROM orders o GROUP BY 1, 2)""",
    "daily_precip_raw": """
daily_precip_raw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS station, CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS precip,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS snow,
         sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS snow_depth,
         min(l_discount) * 1000 AS tempmin, max(l_discount) * 1000 AS tempmax
  FROM lineitem GROUP BY 1, 2)""",
    "precip_silver": """
precip_silver AS (
  SELECT station, date, precip, snow, snow_depth, tempmin, tempmax,
         strftime(date, '%b') AS month, CAST(year(date) AS INTEGER) AS year,
         CASE WHEN precip > 0 THEN 1 ELSE 0 END AS precip_day,
         CAST(year(date) - CASE WHEN month(date) >= 8 THEN 0 ELSE 1 END AS INTEGER) AS season_start,
         CAST(year(date) - CASE WHEN month(date) >= 8 THEN 0 ELSE 1 END AS VARCHAR) || '-' ||
           CAST(year(date) - CASE WHEN month(date) >= 8 THEN 0 ELSE 1 END + 1 AS VARCHAR) AS snow_season,
         CAST(year(date) + CASE WHEN month(date) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS water_year,
         {doy_cal} AS day_of_year,
         CASE WHEN tempmin > 37 THEN precip WHEN tempmax < 29 THEN 0.0
              WHEN precip - snow / 8.0 IS NULL THEN NULL
              ELSE greatest(precip - snow / 8.0, 0.0) END AS rain
  FROM daily_precip_raw),
silver AS (SELECT *, precip - rain AS snow_water_equiv FROM precip_silver)""",
    "hourly": """
hourly AS (
  SELECT event_type AS station, date_trunc('hour', ts) AS timestamp,
         avg(value) AS temp, max(value) AS humidity, min(value) AS dew_point,
         sum(CASE WHEN value < 5 THEN value END) / 10.0 AS precip,
         sum(CASE WHEN value < 3 THEN value END) / 10.0 AS rain,
         sum(CASE WHEN value >= 3 AND value < 5 THEN value END) / 10.0 AS snow,
         avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS cloud_cover,
         stddev_samp(value) AS wind_speed,
         CAST(count(*) AS DOUBLE) AS pressure
  FROM events GROUP BY 1, 2)""",
    "wind": """
wind AS (
  SELECT event_type AS station, CAST(ts AS DATE) AS date, value AS wind_speed,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 3.6 AS wind_direction
  FROM events)""",
    "sun_times": """
sun_times AS (
  SELECT event_type AS station, CAST(ts AS DATE) AS day, strftime(min(ts), '%Y-%m-%dT%H:%M') AS sunrise,
         strftime(max(ts), '%Y-%m-%dT%H:%M') AS sunset FROM events GROUP BY 1, 2)""",
    "category_measures": """
category_measures AS (
  SELECT r.r_name AS continent, c.c_acctbal AS measure
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)""",
}


def doy_sql(d: str, shift: int = 0) -> str:
    """DuckDB twin of ``calendar.doy_index``."""
    leap = f"((year({d}) % 4 = 0 AND year({d}) % 100 <> 0) OR year({d}) % 400 = 0)"
    v = (f"(CASE WHEN {leap} AND dayofyear({d}) > 60 THEN dayofyear({d}) - 1.0 "
         f"WHEN {leap} AND dayofyear({d}) = 60 THEN 59.5 ELSE CAST(dayofyear({d}) AS DOUBLE) END)")
    if shift == 0:
        return v
    return f"((({v} + {shift - 1}.0) % 365.0 + 365.0) % 365.0 + 1)"


def with_fixtures(*names: str) -> str:
    """``WITH`` clause holding the requested fixture CTEs (dependencies first)."""
    deps = {"precip_silver": ["daily_precip_raw"]}
    order: list[str] = []
    for n in names:
        for d in deps.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    parts = [FIXTURE_SQL[n].strip().format(doy_cal=doy_sql("date")) for n in order]
    return "WITH " + ",\n".join(parts)
