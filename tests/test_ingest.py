import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climo.sources import fixtures as fx
from climo.sources import ingest
from tests.conftest import SF_SMALL


def test_upsert_restores_original_rows(spark):
    raw = fx.daily_precip_raw(spark, SF_SMALL)
    existing, new = fx.incremental_batches(spark, SF_SMALL)
    merged = ingest.upsert_coalesce(existing, new)
    cut = dt.date.fromisoformat(fx.INCREMENT_CUT)
    assert merged.count() == raw.count()
    cols = ["station", "date", "precip", "snow", "tempmin", "tempmax"]
    diff = merged.select(*cols).exceptAll(raw.select(*cols))
    assert diff.count() == 0
    # rows only in the batch have no value for the column the batch lacks
    assert merged.filter((F.col("date") >= cut) & F.col("snow_depth").isNotNull()).count() == 0


def test_assert_unique_key(spark):
    df = spark.createDataFrame([("s", dt.date(2000, 1, 1)), ("s", dt.date(2000, 1, 1)), ("s", None)],
                               "station string, date date")
    with pytest.raises(ingest.KeyCheckFailed):
        ingest.assert_unique_key(df)
    ok = spark.createDataFrame([("s", dt.date(2000, 1, 1))], "station string, date date")
    assert ingest.assert_unique_key(ok) is ok


def test_guarded_append(spark):
    base = spark.createDataFrame([(1, 2.0)], "a int, b double")
    path = tempfile.mkdtemp(prefix="climo-append-")
    out = os.path.join(path, "t")
    base.write.parquet(out)
    assert ingest.guarded_append(base, base, out, max_rows=5) == 1
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(ingest.AppendRejected):
        ingest.guarded_append(base, spark.createDataFrame([(1, "x")], "a int, b string"), out)
    with pytest.raises(ingest.AppendRejected):
        ingest.guarded_append(base, spark.range(10).selectExpr("cast(id as int) a", "1.0d b"), out, max_rows=5)


def test_null_watermark_no_nulls_returns_max(spark):
    df = spark.createDataFrame([("s", dt.date(2001, 1, 1), 1.0), ("s", dt.date(2001, 5, 1), 1.0)],
                               "station string, date date, precip double")
    r = ingest.null_watermark(df, "2001-06-01", fields=["precip"]).first()
    assert r["start_date"] == dt.date(2001, 5, 1) and r["end_date"] == dt.date(2001, 5, 31)


def test_read_json_landing_coerces_and_renames(spark):
    rows = fx.daily_precip_raw(spark, SF_SMALL).limit(5).collect()
    payload = [{"DATE": r["date"].isoformat() + "T00:00:00", "STATION": r["station"],
                "PRCP": str(r["precip"]), "SNOW": "bad" if i == 0 else str(r["snow"])} for i, r in enumerate(rows)]
    d = tempfile.mkdtemp(prefix="climo-landing-")
    with open(os.path.join(d, "batch.json"), "w") as f:
        json.dump(payload, f)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["DATE", "STATION", "PRCP", "SNOW"]])
    df = ingest.read_json_landing(spark, d, schema)
    assert set(df.columns) >= {"date", "station", "precip", "snow", "insert_timestamp"}
    got = df.orderBy("station", "date").collect()
    assert len(got) == 5 and dict(df.dtypes)["precip"] == "double"
    assert sum(1 for r in got if r["snow"] is None) >= 1          # 'bad' → NULL


def test_read_csv_landing_nan_to_null(spark):
    d = tempfile.mkdtemp(prefix="climo-csv-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("date,Dew Point,max_temp\n2000-01-01,NaN,5.5\n2000-01-02,3.0,6.0\n")
    schema = "date date, `Dew Point` double, max_temp double"
    df = ingest.read_daily_csv(spark, os.path.join(d, "*.csv"), T._parse_datatype_string(schema),
                               rename=ingest.DASHBOARD_RENAME)
    rows = df.orderBy("date").collect()
    assert rows[0]["dew_point"] is None and rows[1]["dew_point"] == 3.0


def test_null_profile(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    out = {r["column_name"]: r["pct_null"] for r in ingest.null_profile(df).collect()}
    assert out == {"a": 50.0, "b": 100.0}


def test_read_vendor_csv(spark):
    d = tempfile.mkdtemp(prefix="climo-vendor-")
    with open(os.path.join(d, "v.csv"), "w") as f:
        f.write("Address,Date time,Minimum Temperature,Maximum Temperature,Wind Speed\n"
                "x,01/02/2020,10.5,20.0,NaN\nx,01/03/2020,11.0,21.0,3.0\n")
    schema = T._parse_datatype_string("Address string, `Date time` string, `Minimum Temperature` double, "
                                      "`Maximum Temperature` double, `Wind Speed` double")
    rows = ingest.read_vendor_csv(spark, d, schema).orderBy("date").collect()
    assert rows[0]["date"] == dt.date(2020, 1, 2) and rows[0]["min_temp"] == 10.5 and rows[0]["wind_speed"] is None
