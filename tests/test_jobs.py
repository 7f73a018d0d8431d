import json
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from climo.plans import jobs
from climo.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_ingest_to_silver_and_normals_jobs(spark):
    raw = fx.daily_precip_raw(spark, SF_SMALL)
    rows = raw.filter(F.col("date") >= "2001-01-01").collect()
    base = tempfile.mkdtemp(prefix="climo-jobs-")
    landing = os.path.join(base, "landing")
    os.makedirs(landing)
    with open(os.path.join(landing, "p.json"), "w") as f:
        json.dump([{"DATE": r["date"].isoformat(), "STATION": r["station"], "PRCP": str(r["precip"]),
                    "SNOW": str(r["snow"]) if r["snow"] is not None else None,
                    "TMIN": str(r["tempmin"]), "TMAX": str(r["tempmax"])} for r in rows], f)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["DATE", "STATION", "PRCP", "SNOW", "TMIN", "TMAX"]])
    existing = raw.filter(F.col("date") < "2001-01-01").drop("snow_depth")
    existing = existing.withColumn("insert_timestamp", F.current_timestamp())
    out = jobs.ingest_to_silver(spark, landing, schema, existing, os.path.join(base, "out"))
    silver = spark.read.parquet(out["silver"])
    assert silver.count() == raw.count()
    assert {"rain", "snow_water_equiv", "water_year", "snow_season", "day_of_year"} <= set(silver.columns)

    p = jobs.precipitation_normals_job(silver, os.path.join(base, "normals"))
    assert spark.read.parquet(p["precip_monthly_normals"]).count() > 0
    assert set(r[0] for r in spark.read.parquet(p["precip_ytd_normals"]).select("year_type").distinct().collect()) \
        <= {"calendar_year", "water_year", "snow_season"}
    t = jobs.temperature_normals_job(fx.daily_temps(spark, SF_SMALL, dense=True), (1996, 2000),
                                     os.path.join(base, "normals"))
    assert spark.read.parquet(t).count() == 366


def test_hourly_ingest_job(spark):
    from climo.sources import ingest
    h = fx.hourly(spark, SF_SMALL).filter(F.col("station") == "click").orderBy("timestamp").collect()
    base = tempfile.mkdtemp(prefix="climo-hourly-")
    cols = list(ingest.HOURLY_RENAME.keys())
    paths = []
    for i, chunk in enumerate((h[: len(h) // 2], h[len(h) // 2:])):
        p = os.path.join(base, f"period{i}.csv")
        with open(p, "w") as f:
            f.write(",".join(f'"{c}"' for c in cols) + "\n")
            for r in chunk:
                vals = [r["timestamp"].strftime("%Y-%m-%dT%H:%M"), r["temp"], r["humidity"], r["dew_point"],
                        r["precip"], r["rain"], r["temp"], r["snow"], r["cloud_cover"], r["wind_speed"], r["pressure"]]
                f.write(",".join("" if v is None else str(v) for v in vals) + "\n")
        paths.append(p)
    sun_rows = fx.sun_times(spark, SF_SMALL).filter(F.col("station") == "click").collect()
    sun_p = os.path.join(base, "sun.csv")
    with open(sun_p, "w") as f:
        f.write("time,sunrise (iso8601),sunset (iso8601)\n")
        for r in sun_rows:
            f.write(f"{r['day'].isoformat()},{r['sunrise']},{r['sunset']}\n")
    hs = T.StructType([T.StructField(c, T.StringType() if c == "time" else T.DoubleType()) for c in cols])
    ss = T.StructType([T.StructField(c, T.StringType()) for c in ["time", "sunrise (iso8601)", "sunset (iso8601)"]])
    path = jobs.hourly_ingest_job(spark, paths, hs, sun_p, ss, os.path.join(base, "out"))
    out = spark.read.parquet(path)
    assert out.count() == len(h)
    assert {"temp", "humidity", "apparent_temp", "sunrise", "sunset", "day", "year"} <= set(out.columns)
    assert out.filter(F.col("sunrise").isNull()).count() == 0


def test_vendor_append_job(spark):
    import datetime as dt
    base = tempfile.mkdtemp(prefix="climo-vendor-job-")
    table = os.path.join(base, "table")
    spark.createDataFrame([(dt.date(2020, 1, 1), 1.0, 2.0), (dt.date(2020, 1, 2), 1.5, 2.5)],
                          "date date, min_temp double, max_temp double").write.parquet(table)
    landing = os.path.join(base, "landing")
    os.makedirs(landing)
    with open(os.path.join(landing, "v.csv"), "w") as f:
        f.write("Address,Date time,Minimum Temperature,Maximum Temperature\n"
                "x,01/02/2020,1.5,2.5\nx,01/03/2020,2.0,3.0\nx,01/04/2020,2.5,3.5\n")
    schema = T._parse_datatype_string("Address string, `Date time` string, `Minimum Temperature` double, "
                                      "`Maximum Temperature` double")
    res = jobs.vendor_append_job(spark, landing, schema, table, "2020-01-10")
    assert res["appended"] == 2
    r = res["ranges"].first()
    assert r["start_date"] == dt.date(2020, 1, 3) and r["days_to_update"] == 7
    assert spark.read.parquet(table).count() == 4
