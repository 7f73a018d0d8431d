"""SURVEY §4.1 semantic decisions on hand-made micro-frames."""

import datetime as dt

from pyspark.sql import functions as F

from climo.operators import aggregates as agg
from climo.operators import normals, reshape
from climo.plans import views
from climo.sources.ingest import build_precip_silver


def _d(s):
    return dt.date.fromisoformat(s)


def _raw(spark, rows):
    return spark.createDataFrame(rows, "station string, date date, precip double, snow double, snow_depth double, "
                                       "tempmin double, tempmax double")


def test_q5_complete_season_bounds_integer_rules(spark):
    # data from 1995-09-10 to 2001-06-30: first complete season starts 1996, last complete season starts 2000
    df = spark.createDataFrame([("s", _d("1995-09-10")), ("s", _d("2001-06-30"))], "station string, date date")
    b = agg.complete_season_bounds(df).first()
    assert (b["min_season"], b["max_season"]) == (1996, 2000)
    df2 = spark.createDataFrame([("s", _d("1995-07-10")), ("s", _d("2001-07-30"))], "station string, date date")
    b2 = agg.complete_season_bounds(df2).first()
    assert (b2["min_season"], b2["max_season"]) == (1995, 2001)


def test_q6_q9_normal_windows_decade_and_trailing(spark):
    rows = [("s", _d(f"{y}-{m:02d}-15"), 1.0, 0.0, 0.0, 50.0, 60.0) for y in range(1985, 2026) for m in (1, 9)]
    st_dec = reshape.stack_calendars(build_precip_silver(_raw(spark, rows)), mode="decade")
    cal_rng = (st_dec.filter("year_type = 'calendar_year' AND norm_range")
               .agg(F.min("year_num"), F.max("year_num")).first())
    assert tuple(cal_rng) == (1991, 2020)            # last complete decade of 2025
    snow_rng = (st_dec.filter("year_type = 'snow_season' AND norm_range")
                .agg(F.min("year_num"), F.max("year_num")).first())
    assert tuple(snow_rng) == (1991, 2020)           # latest season 2025-2026 shifted by (2025-1991, 2025-2020)
    st_tr = reshape.stack_calendars(build_precip_silver(_raw(spark, rows)), mode="trailing")
    tr = st_tr.filter("year_type = 'calendar_year' AND norm_range").agg(F.min("year_num"), F.max("year_num")).first()
    assert tuple(tr) == (1995, 2025)                 # inclusive 31 years
    sn = st_tr.filter("year_type = 'snow_season' AND norm_range").agg(F.min("year_num"), F.max("year_num")).first()
    assert tuple(sn) == (1996, 2024)


def test_q8_categories_observed_by_default_complete_on_request(spark):
    wind = spark.createDataFrame([("s", _d("2000-01-01"), 5.0, 10.0), ("s", _d("2000-01-02"), 12.0, 95.0)],
                                 "station string, date date, wind_speed double, wind_direction double")
    wr = agg.wind_rose(wind)
    assert wr.count() == 2
    from climo.functions import derive as dv
    full = reshape.complete_categories(wr, ["station"], {"wind_speed_cat": dv.WIND_SPEED_LABELS,
                                                         "wind_direction_cat": [i * 22.5 for i in range(16)]},
                                       {"frequency": 0, "share": 0.0})
    assert full.count() == 6 * 16 and full.agg(F.sum("frequency")).first()[0] == 2


def test_q10_mtd_min_max_all_years_mean_norm_years(spark):
    # Jan 1 precipitation: 1989 → 100 (outside the decade window 1991-2020), later years → 1..
    rows = [("s", _d(f"{y}-01-01"), 100.0 if y == 1989 else float(y - 1990), 0.0, 0.0, 50.0, 60.0)
            for y in range(1989, 2026)]
    out = normals.mtd_normals(build_precip_silver(_raw(spark, rows)), metrics=["precip"]).first()
    assert out["max_precip_mtd"] == 100.0             # min / max over every past year
    assert out["avg_precip_mtd"] == sum(range(1, 31)) / 30.0   # mean over 1991-2020 only


def test_q16_record_dates_earliest_on_ties(spark):
    df = spark.createDataFrame([("s", _d("2001-07-02"), 10.0, 5.0, 7.0), ("s", _d("1999-07-05"), 10.0, 5.0, 7.0),
                                ("s", _d("2000-07-01"), 9.0, 5.0, 7.0)],
                               "station string, date date, max_temp double, min_temp double, avg_temp double")
    r = agg.month_climate_summary(df, dp=None).first()
    assert r["record_high_date"] == _d("1999-07-05") and r["record_low_date"] == _d("1999-07-05")


def test_q17_observed_vs_normal_drops_precip_day(spark):
    rows = [("s", _d(f"{y}-03-0{d}"), 1.0, 0.0, 0.0, 50.0, 60.0) for y in range(1995, 2002) for d in (1, 2)]
    silver = build_precip_silver(_raw(spark, rows))
    out = views.observed_vs_normal(silver, normals.precip_monthly_normals(silver))
    metrics = {r[0] for r in out.select("metric_name").distinct().collect()}
    assert metrics == {"precip", "snow", "rain"}


def test_records_page_as_of_and_recent_flag(spark):
    from climo.operators import records
    rec = spark.createDataFrame([("s", 1, "2001-07-01", 99.123, "hottest_day"), ("s", 2, "1995-07-02", 98.0, "hottest_day"),
                                 ("s", 1, "2001-01-01", 1.0, "coldest_day")],
                                "station string, rank int, date string, metric_value double, record string")
    observed = spark.createDataFrame([("s", dt.date(2003, 1, 1)), ("s", dt.date(1990, 1, 1))], "station string, date date")
    page = {r["date"]: r for r in records.records_page(rec, "hottest_day", observed=observed).collect()}
    assert set(page) == {"2001-07-01", "1995-07-02"}
    assert page["2001-07-01"]["recent"] and not page["1995-07-02"]["recent"]
    assert page["2001-07-01"]["metric_value"] == 99.12
    fixed = {r["date"]: r["recent"] for r in records.records_page(rec, "hottest_day", as_of_year=1997).collect()}
    assert fixed == {"2001-07-01": False, "1995-07-02": True}
    late = spark.createDataFrame([("s", dt.date(2004, 1, 1))], "station string, date date")     # the latest year of the data, not of the records
    assert not any(r["recent"] for r in records.records_page(rec, "hottest_day", observed=late).collect())


def test_hourly_density_excludes_last_year_by_default(spark):
    rows = [("s", dt.datetime(y, 1, 1, h), float(h), float(h)) for y in (2022, 2023, 2024) for h in range(3)]
    h = spark.createDataFrame(rows, "station string, timestamp timestamp_ntz, temp double, dew_point double")
    cells = lambda df: df.filter("level = 0").agg(F.sum("n")).first()[0]
    dflt = views.hourly_density(h, "temp", "dew_point", ["Jan"], (0.0, 10.0), (0.0, 10.0))
    incl = views.hourly_density(h, "temp", "dew_point", ["Jan"], (0.0, 10.0), (0.0, 10.0), exclude_last_year=False)
    assert cells(dflt) == 6 and cells(incl) == 9


def test_mtd_normals_sketch_option_close_to_exact(spark):
    rows = [("s", _d(f"{y}-01-0{d}"), float((y * 7 + d) % 11), 0.0, 0.0, 50.0, 60.0)
            for y in range(1985, 2026) for d in (1, 2, 3)]
    silver = build_precip_silver(_raw(spark, rows))
    ex = {(r["metric_name"], r["day_of_month"]): r for r in normals.mtd_normals(silver, metrics=["precip"]).collect()}
    ap = {(r["metric_name"], r["day_of_month"]): r
          for r in normals.mtd_normals(silver, metrics=["precip"], exact=False).collect()}
    assert ex.keys() == ap.keys()
    for k, r in ex.items():
        assert r["avg_precip_mtd"] == ap[k]["avg_precip_mtd"]            # means are exact either way
        for p in ("p10", "p50", "p90"):
            a, b = r[f"{p}_precip_mtd"], ap[k][f"{p}_precip_mtd"]
            assert abs(a - b) <= 3.0                                      # sketch returns an observed value nearby
