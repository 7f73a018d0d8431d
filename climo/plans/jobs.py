"""End-to-end jobs: landing → raw → silver, and the
normals tables.  Each job is one lazy plan per output; results are written
as new Parquet folders (never over the folder being read).
"""

from __future__ import annotations

import os
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from climo.operators import normals
from climo.operators import regression as rg
from climo.sources import ingest


def ingest_to_silver(spark: SparkSession, landing_dir: str, landing_schema: T.StructType,
                     existing: DataFrame | None, out_dir: str,
                     keys: Sequence[str] = ("station", "date")) -> dict:
    """Landing JSON → coerced batch → upsert into the raw table → key
    check → silver table.  The merged table is staged below
    ``<out_dir>/_staged`` and checked there; only then ``<out_dir>/raw`` and
    ``<out_dir>/silver`` are written.  Returns their paths."""
    batch = ingest.read_json_landing(spark, landing_dir, landing_schema)
    raw = batch if existing is None else ingest.upsert_coalesce(existing, batch, keys)
    raw_path = os.path.join(out_dir, "raw")
    staged_path = os.path.join(out_dir, "_staged", uuid.uuid4().hex)
    ingest.write_table(raw, staged_path)
    raw = spark.read.parquet(staged_path)
    ingest.assert_unique_key(raw, keys)
    ingest.write_table(raw, raw_path)
    silver_path = os.path.join(out_dir, "silver")
    ingest.write_table(ingest.build_precip_silver(raw, [k for k in keys if k != "date"]), silver_path,
                       partition_by=["year"])
    return {"raw": raw_path, "silver": silver_path}


def temperature_normals_job(daily: DataFrame, years: tuple, out_dir: str,
                            keys: Sequence[str] = ("station",)) -> str:
    """The 366-row daily normals table per station."""
    path = os.path.join(out_dir, "temp_daily_normals")
    ingest.write_table(rg.daily_normals(daily, years, keys), path)
    return path


def precipitation_normals_job(silver: DataFrame, out_dir: str, keys: Sequence[str] = ("station",),
                              n_years: int = 30) -> dict:
    """Monthly, month-to-date and year-to-date precipitation normals."""
    paths = {name: os.path.join(out_dir, name) for name in
             ("precip_monthly_normals", "precip_mtd_normals", "precip_ytd_normals")}
    ingest.write_table(normals.precip_monthly_normals(silver, keys, n_years), paths["precip_monthly_normals"])
    ingest.write_table(normals.mtd_normals(silver, keys, n_years=n_years), paths["precip_mtd_normals"])
    ingest.write_table(normals.ytd_normals(silver, keys, n_years=n_years), paths["precip_ytd_normals"],
                       partition_by=["year_type"])
    return paths


def hourly_ingest_job(spark: SparkSession, period_paths: Sequence[str], hourly_schema: T.StructType,
                      sun_path: str, sun_schema: T.StructType, out_dir: str) -> str:
    """Hourly ingest: read the period CSV files as one scan (S4), rename the
    export columns (P2), add the day and join that day's sunrise / sunset
    (J5), write the hourly table partitioned by year (S6)."""
    from pyspark.sql import functions as F
    hourly = ingest.read_multi(spark, period_paths, hourly_schema, rename=ingest.HOURLY_RENAME)
    hourly = hourly.withColumn("timestamp", F.to_timestamp_ntz(F.col("timestamp").cast("string")))
    sun = ingest.read_daily_csv(spark, sun_path, sun_schema, rename=ingest.SUN_TIMES_RENAME)
    sun = sun.withColumn("day", F.to_date(F.col("day").cast("string")))
    on = ["day"] + [c for c in ("station",) if c in hourly.columns and c in sun.columns]
    out = (hourly.withColumn("day", F.to_date("timestamp"))
           .join(sun, on, "left")
           .withColumn("year", F.year("timestamp")))
    path = os.path.join(out_dir, "hourly")
    ingest.write_table(out, path, partition_by=["year"])
    return path


def vendor_append_job(spark: SparkSession, landing_path: str, landing_schema: T.StructType, table_path: str,
                      as_of, max_rows: int = ingest.APPEND_GUARD_ROWS, keys: Sequence[str] = ()) -> dict:
    """Vendor daily feed: where to resume (S9, per key), read the landed CSV
    export (S3), keep only days after the stored maximum, and append under
    the schema / size guard (S7).  Returns the resume ranges (a DataFrame,
    one row per key) and the number of appended rows."""
    from pyspark.sql import functions as F
    existing = spark.read.parquet(table_path)
    ranges = ingest.next_range(existing, as_of, keys=keys) if keys else \
        ingest.next_range(existing.withColumn("_all", F.lit(1)), as_of, keys=["_all"]).drop("_all")
    new = ingest.read_vendor_csv(spark, landing_path, landing_schema)
    new = new.select(*existing.columns)
    if keys:
        mx = existing.groupBy(*keys).agg(F.max("date").alias("_mx"))
        new = new.join(mx, list(keys), "left").filter(F.col("_mx").isNull() | (F.col("date") > F.col("_mx")))
        new = new.select(*existing.columns)
    else:
        mx = existing.agg(F.max("date").alias("_mx")).withColumn("_one", F.lit(1))
        new = (new.withColumn("_one", F.lit(1)).join(F.broadcast(mx), "_one")
               .filter(F.col("_mx").isNull() | (F.col("date") > F.col("_mx"))).select(*existing.columns))
    ranges = ranges.checkpoint(eager=True)        # computed before the table grows
    n = ingest.guarded_append(existing, new, table_path, max_rows)
    return {"ranges": ranges, "appended": n}
