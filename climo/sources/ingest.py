"""Landing-file scans, incremental merge and the silver-table job.

The reference pulls JSON / CSV from two web services; here the service
payloads are assumed to have been dropped as files in a landing folder, and
every step after the download is a Spark job.
"""

from __future__ import annotations

import uuid
from typing import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climo.functions import calendar as cal
from climo.functions import derive as dv

# ---- fixed values: field names of the daily-summaries payload -------------
DAILY_SUMMARY_RENAME = {
    "DATE": "date",
    "TMAX": "tempmax",
    "TMIN": "tempmin",
    "TAVG": "tempavg",
    "PRCP": "precip",
    "SNOW": "snow",
    "SNWD": "snow_depth",
    "STATION": "station",
    "NAME": "location",
    "ACMH": "avg_cloud",
    "ACSH": "avg_cloud_daytime",
    "AWND": "avg_wind",
    "PSUN": "sun_perc",
    "SN02": "min_soil_temp_10cm",
    "SN03": "min_soil_temp_20cm",
    "SX02": "max_soil_temp_10cm",
    "SX03": "max_soil_temp_20cm",
    "TSUN": "sunshine_hours",
    "WDF2": "wind_direction",
    "WESD": "water_snow_depth",
}
HOURLY_RENAME = {
    "time": "timestamp",
    "temperature_2m (°F)": "temp",
    "relative_humidity_2m (%)": "humidity",
    "dew_point_2m (°F)": "dew_point",
    "precipitation (inch)": "precip",
    "rain (inch)": "rain",
    "apparent_temperature (°F)": "apparent_temp",
    "snowfall (inch)": "snow",
    "cloud_cover (%)": "cloud_cover",
    "wind_speed_10m (mp/h)": "wind_speed",
    "pressure_msl (hPa)": "pressure",
}
SUN_TIMES_RENAME = {"time": "day", "sunset (iso8601)": "sunset", "sunrise (iso8601)": "sunrise"}
# The vendor feed maps 'ASea Level Pressure' (never present); the dashboard
# renames 'Sea Level Pressure' itself, so both spellings are listed.
VENDOR_RENAME = {
    "Minimum Temperature": "min_temp",
    "Maximum Temperature": "max_temp",
    "Temperature": "avg_temp",
    "Wind Chill": "wind_chill",
    "ASea Level Pressure": "pressure",
    "Precipitation": "precipitation",
    "Snow Depth": "snow_depth",
    "Snowfall": "snowfall",
    "Wind Speed": "wind_speed",
}
DASHBOARD_RENAME = {
    "Dew Point": "dew_point",
    "Cloud Cover": "cloud_cover",
    "Sea Level Pressure": "pressure",
    "Heat Index": "heat_index",
    "Wind Direction": "wind_direction",
}
INCREMENTAL_NEEDED_FIELDS = ["tempavg", "tempmax", "tempmin", "precip", "snow"]
APPEND_GUARD_ROWS = 1000
# ---------------------------------------------------------------------------

SILVER_COLUMNS = ["date", "precip", "snow", "snow_depth", "tempmin", "tempmax"]


def _double_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (Q1)."""
    cols = _double_cols(df)
    if not cols:
        return df
    return df.withColumns({c: dv.nan_to_null(c) for c in cols})


def read_daily_csv(spark: SparkSession, path, schema: T.StructType,
                   date_format: str = "yyyy-MM-dd", rename: dict | None = None) -> DataFrame:
    """Header CSV(s) with an explicit schema; one path, a list or a glob."""
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
          .option("dateFormat", date_format).csv(path))
    if rename:
        df = df.withColumnsRenamed(rename)
    return nan_to_null_all(df)


def read_vendor_csv(spark: SparkSession, path, schema: T.StructType,
                    rename: dict | None = VENDOR_RENAME) -> DataFrame:
    """S3: vendor daily CSV export (one date range per file): ``Date time`` →
    ``date``, columns renamed, NaN → NULL."""
    df = read_daily_csv(spark, path, schema, rename=rename)
    if "Date time" in df.columns:
        df = df.withColumn("date", F.to_date(F.col("Date time").cast("string"), "MM/dd/yyyy")).drop("Date time")
    return df


def read_multi(spark: SparkSession, paths: Sequence[str], schema: T.StructType,
               rename: dict | None = None) -> DataFrame:
    """Read N period files as one scan and rename columns."""
    return read_daily_csv(spark, list(paths), schema, rename=rename)


def read_json_landing(spark: SparkSession, path, schema: T.StructType,
                      rename: dict | None = DAILY_SUMMARY_RENAME,
                      numeric_cols: Iterable[str] | None = None) -> DataFrame:
    """JSON record arrays (one payload per file) → typed table stamped with load time.

    Fields arrive as strings; numeric ones are coerced with ``try_cast``
    (invalid → NULL), dates are parsed, and ``insert_timestamp`` records the load.
    """
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if rename:
        df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    if "date" in df.columns:
        df = df.withColumn("date", F.to_date(F.substring(F.col("date").cast("string"), 1, 10)))
    numeric = list(numeric_cols) if numeric_cols is not None else [
        c for c in df.columns if c not in ("date", "station", "location")]
    df = df.withColumns({c: dv.to_numeric(F.col(c)) for c in numeric if c in df.columns})
    return df.withColumn("insert_timestamp", F.current_timestamp())


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A small result table (normals, sun times)."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Write a result.  Never overwrite the path being read: write a new folder."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


class AppendRejected(ValueError):
    pass


def guarded_append(existing: DataFrame, new: DataFrame, path: str,
                   max_rows: int = APPEND_GUARD_ROWS) -> int:
    """Append ``new`` to the table at ``path`` iff the schemas match and
    ``new`` has at most ``max_rows`` rows.  The count is bounded
    (``limit(max_rows + 1)``) so a runaway batch is not counted in full.
    The batch is read once: at most ``max_rows + 1`` of its rows go to a folder
    beside the table (``<path>_staged/<uuid>``), are counted there and, if
    there are few enough, appended from there, so what is counted is what is
    appended.  Returns the number of rows appended.
    """
    if [(f.name, f.dataType) for f in existing.schema.fields] != \
            [(f.name, f.dataType) for f in new.schema.fields]:
        raise AppendRejected("schema mismatch between existing table and new batch")
    staged_path = f"{path.rstrip('/')}_staged/{uuid.uuid4().hex}"
    new.limit(max_rows + 1).write.parquet(staged_path)
    staged = new.sparkSession.read.schema(new.schema).parquet(staged_path)
    n = staged.count()
    if n > max_rows:
        raise AppendRejected(f"batch has more than {max_rows} rows")
    staged.write.mode("append").parquet(path)
    return n


def latest_per_key(batch: DataFrame, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """One row per key: the one with the largest ``order_by`` (load time), ties
    and missing ``order_by`` decided by the other values, so reruns agree.
    Drops ``order_by``."""
    rest = [c for c in batch.columns if c not in keys and c != order_by]
    row = F.struct(*rest)
    order = F.struct(F.col(order_by), row) if order_by else row
    picked = batch.groupBy(*keys).agg(F.max_by(row, order).alias("_row"))
    return picked.select(*keys, "_row.*")


def null_watermark(df: DataFrame, as_of, fields: Sequence[str] = INCREMENTAL_NEEDED_FIELDS,
                   months: int = 6, keys: Sequence[str] = ("station",),
                   date_col: str = "date") -> DataFrame:
    """Per key, where an incremental pull should start and end.

    start = earliest date in the last ``months`` months (relative to ``as_of``)
    where any needed field is NULL; when no recent row has a NULL, the
    latest date (the reference's intent; it produced NaN there); end =
    ``as_of - 1 day``.
    """
    as_of_c = F.lit(as_of).cast("date")
    recent = F.col(date_col) >= F.add_months(as_of_c, -months)
    any_null = None
    for f in fields:
        cond = F.col(f).isNull()
        any_null = cond if any_null is None else (any_null | cond)
    return (df.groupBy(*keys)
            .agg(F.min(F.when(recent & any_null, F.col(date_col))).alias("first_null_date"),
                 F.max(date_col).alias("max_date"))
            .select(*keys,
                    F.coalesce("first_null_date", "max_date").alias("start_date"),
                    F.date_sub(as_of_c, 1).alias("end_date")))


def next_range(df: DataFrame, as_of, keys: Sequence[str] = ("station",),
               date_col: str = "date") -> DataFrame:
    """Resume the day after the latest stored date; number of days to fetch."""
    as_of_c = F.lit(as_of).cast("date")
    return (df.groupBy(*keys).agg(F.max(date_col).alias("max_date"))
            .select(*keys, F.date_add("max_date", 1).alias("start_date"),
                    F.datediff(as_of_c, F.date_add("max_date", 1)).alias("days_to_update")))


def upsert_coalesce(existing: DataFrame, new: DataFrame,
                    keys: Sequence[str] = ("station", "date"), order_by: str | None = None) -> DataFrame:
    """Merge a batch into a table: new values win, NULLs in the batch keep
    the stored value, unseen rows and columns are kept.

    Only columns the table already has are taken from the batch.  The table
    is split with a semi/anti join against the batch so that only the rows
    the batch touches take part in the outer merge; the untouched bulk of the
    table is never shuffled when the batch is small enough to broadcast
    (AQE decides at run time from the batch's real size).  Rows of the batch
    with one key are first reduced to one (``latest_per_key``), so keys that
    are unique in the table stay unique.
    """
    keys = list(keys)
    common = [c for c in new.columns if c in existing.columns and c not in keys]
    batch = new.select(*keys, *common, *([order_by] if order_by and order_by not in common else []))
    batch = latest_per_key(batch, keys, order_by if order_by and order_by not in common else None) if common else batch.distinct()
    batch_keys = batch.select(*keys)
    untouched = existing.join(batch_keys, keys, "left_anti")
    touched = existing.join(batch_keys, keys, "left_semi")
    o = touched.alias("o")
    n = batch.alias("n")
    merged = o.join(n, keys, "full_outer")
    out_cols = []
    for c in existing.columns:
        if c in keys:
            out_cols.append(F.col(c))
        elif c in common:
            out_cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).cast(existing.schema[c].dataType).alias(c))
        else:
            out_cols.append(F.col(f"o.{c}").alias(c))
    return untouched.unionByName(merged.select(*out_cols))


class KeyCheckFailed(ValueError):
    pass


def key_violations(df: DataFrame, keys: Sequence[str] = ("station", "date")) -> DataFrame:
    """One row: number of duplicated keys and of rows with a NULL key part.

    One aggregate over the per-key counts (partial aggregation before the
    shuffle), then a global aggregate of that."""
    null_any = None
    for k in keys:
        cond = F.col(k).isNull()
        null_any = cond if null_any is None else (null_any | cond)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
                       F.coalesce(F.sum(F.when(null_any, F.col("_n"))), F.lit(0)).alias("null_keys"))


def assert_unique_key(df: DataFrame, keys: Sequence[str] = ("station", "date")) -> DataFrame:
    """Fail the job when the key is duplicated or NULL; returns ``df``."""
    row = key_violations(df, keys).first()
    if row["duplicate_keys"] or row["null_keys"]:
        raise KeyCheckFailed(f"duplicate keys: {row['duplicate_keys']}, null keys: {row['null_keys']}")
    return df


def build_precip_silver(raw: DataFrame, keys: Sequence[str] = ("station",),
                        season_start_month: int = 8, water_start_month: int = 10,
                        swe_ratio: float = dv.SWE_RATIO) -> DataFrame:
    """Raw daily precipitation → silver table (one narrow projection).

    Adds month / year / precip_day / snow season / water year / day index and
    splits precipitation into rain and snow water equivalent.
    """
    cols = [c for c in SILVER_COLUMNS if c in raw.columns]
    df = raw.select(*keys, *cols)
    calc = cal.calendar_columns("date", season_start_month, water_start_month)
    rain = dv.rain("precip", "snow", "tempmin", "tempmax", ratio=swe_ratio)
    return (df.withColumns({
        "month": calc["month"],
        "year": calc["year"],
        "precip_day": dv.precip_day("precip"),
        "season_start": calc["season_start"],
        "snow_season": calc["snow_season"],
        "water_year": calc["water_year"],
        "day_of_year": calc["day_of_year"],
        "rain": rain,
    }).withColumn("snow_water_equiv", dv.snow_water_equiv("precip", "rain")))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Percent of NULL values per column, as one long table (column, pct_null)."""
    cols = list(cols) if cols else df.columns
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "pct_null")
