import datetime as dt

from pyspark.sql import functions as F

from climo.functions import calendar as cal

LEAP_DAYS = [dt.date(1996, 2, 28), dt.date(1996, 2, 29), dt.date(1996, 3, 1), dt.date(1996, 12, 31),
             dt.date(1997, 2, 28), dt.date(1997, 3, 1), dt.date(1997, 12, 31), dt.date(1997, 1, 1)]


def _frame(spark):
    return spark.createDataFrame([(d,) for d in LEAP_DAYS], "date date")


def test_doy_index_leap_day_and_shift(spark):
    rows = {r["date"]: r for r in _frame(spark).select(
        "date", cal.doy_index("date").alias("c"), cal.doy_index("date", "water_year").alias("w"),
        cal.doy_index("date", "snow_season").alias("s")).collect()}
    assert rows[dt.date(1996, 2, 28)]["c"] == 59.0
    assert rows[dt.date(1996, 2, 29)]["c"] == 59.5
    assert rows[dt.date(1996, 3, 1)]["c"] == 60.0
    assert rows[dt.date(1996, 12, 31)]["c"] == 365.0
    assert rows[dt.date(1997, 3, 1)]["c"] == 60.0
    # shifted calendars keep the leap day half way
    assert rows[dt.date(1996, 2, 29)]["w"] == 151.5
    assert rows[dt.date(1996, 2, 29)]["s"] == 212.5
    # Oct 1 is day 1 of the water year, Aug 1 day 1 of the snow season
    oct1 = spark.createDataFrame([(dt.date(1997, 10, 1),), (dt.date(1997, 8, 1),)], "date date")
    r = oct1.select(cal.doy_index("date", "water_year").alias("w"), cal.doy_index("date", "snow_season").alias("s")).collect()
    assert r[0]["w"] == 1.0 and r[1]["s"] == 1.0


def test_doy_label_round_trip_all_366(spark):
    df = spark.range(1, 366).select(F.col("id").cast("double").alias("d")).union(
        spark.createDataFrame([(59.5,)], "d double"))
    out = df.select("d", cal.doy_label("d").alias("lab")).withColumn("back", cal.doy_from_label("lab"))
    bad = out.filter(F.col("d") != F.col("back")).count()
    assert bad == 0
    labels = dict(out.select("d", "lab").collect())
    assert labels[59.5] == "Feb 29" and labels[1.0] == "Jan 01" and labels[365.0] == "Dec 31"


def test_season_and_water_year(spark):
    df = spark.createDataFrame([(dt.date(2000, 7, 31),), (dt.date(2000, 8, 1),), (dt.date(2000, 10, 1),)], "date date")
    r = df.select(cal.season_label(cal.season_start("date")).alias("s"), cal.water_year("date").alias("w")).collect()
    assert [x["s"] for x in r] == ["1999-2000", "2000-2001", "2000-2001"]
    assert [x["w"] for x in r] == [2000, 2000, 2001]
    r2 = spark.createDataFrame([("2000-2001",)], "s string").select(cal.offset_season("s", -3).alias("o")).first()
    assert r2["o"] == "1997-1998"


def test_normal_window():
    assert cal.normal_window(2025, 30, True) == (1991, 2020)
    assert cal.normal_window(2025, 30, False) == (1995, 2024)


def test_season_doy_to_calendar_and_decimal_hour(spark):
    r = spark.createDataFrame([(154.0, "2024-03-01T06:45")], "d double, s string").select(
        cal.season_doy_to_calendar("d").alias("c"), cal.iso_to_decimal_hour("s").alias("h")).first()
    assert r["c"] == 1 and r["h"] == 6.75


def test_season_of_month(spark):
    r = spark.range(1, 13).select(cal.season_of_month(F.col("id")).alias("s")).collect()
    assert [x["s"] for x in r][:3] == ["winter", "winter", "spring"]
    assert [x["s"] for x in r][11] == "winter"


def test_days_since_ignores_session_time_zone(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1), dt.date(2024, 3, 20), dt.datetime(2024, 3, 9, 12, 0),
                                 dt.datetime(2024, 3, 11, 12, 0))], "d0 date, d1 date, t0 timestamp_ntz, t1 timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Denver")     # DST starts 2024-03-10
        r = df.select(cal.days_since("d1", "d0").alias("a"), cal.days_since("t1", "t0").alias("b")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r["a"] == 19.0 and r["b"] == 2.0
