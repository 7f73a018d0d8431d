"""Small public helpers not exercised by the registered queries."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from climo.functions import calendar as cal
from climo.operators import accumulate, aggregates as agg
from climo.sources import ingest


def test_calendar_helpers(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 29), "water_year", "1999-2000", "Year")],
                               "date date, yt string, label string, m string")
    r = df.select(cal.doy_index_for("date", "yt").alias("d"), cal.season_label_start("label").alias("s"),
                  cal.month_num_of_label("m").alias("mn"),
                  cal.months_since("date", F.lit(dt.date(1999, 11, 15))).alias("ms")).first()
    assert r["d"] == 151.5 and r["s"] == 1999 and r["mn"] == 13 and r["ms"] == 3


def test_month_to_date_resets_each_month(spark):
    rows = [("s", "precip", "2000", "Jan", dt.date(2000, 1, d), 1.0) for d in (1, 2, 3)] + \
           [("s", "precip", "2000", "Feb", dt.date(2000, 2, 1), None)]
    df = spark.createDataFrame(rows, "station string, metric_name string, year_for_dash string, month string, "
                                     "date date, metric_value double")
    out = [r["m"] for r in accumulate.month_to_date(df, out_col="m").orderBy("date").collect()]
    assert out == [1.0, 2.0, 3.0, 0.0]


def test_yearly_means_needs_12_months(spark):
    rows = [("s", 2000, m, "max_temp", float(i)) for i, m in enumerate(cal.MONTH_LABELS)]
    rows += [("s", 2001, "Jan", "max_temp", 1.0)]
    df = spark.createDataFrame(rows, "station string, year int, month string, metric string, mean double")
    out = agg.yearly_means(df).collect()
    assert len(out) == 1 and out[0]["year"] == 2000 and out[0]["mean"] == 5.5 and out[0]["month"] == "Year"


def test_read_dimension(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="climo-dim-"), "normals")
    spark.createDataFrame([("s", 1.0, 30.0)], "station string, day_of_year double, normal_high double").write.parquet(path)
    assert ingest.read_dimension(spark, path).count() == 1
