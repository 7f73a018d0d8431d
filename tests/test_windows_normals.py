import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from climo.operators import accumulate, aggregates as agg, normals, reshape, windows
from climo.sources.ingest import build_precip_silver


def _d(s):
    return dt.date.fromisoformat(s)


def test_dry_gaps_0_1_46(spark):
    days = ["2000-01-01", "2000-01-02", "2000-01-04", "2000-02-20"]
    df = spark.createDataFrame([("s", _d(x), 1) for x in days], "station string, date date, precip_day int")
    out = [r["dry_days"] for r in windows.gap_since_previous(df, F.col("precip_day") == 1).orderBy("date").collect()]
    assert out == [None, 0, 1, 46]


def test_streak_islands_partition_rows(spark):
    states = [1, 1, 0, 0, 0, 1, 0]
    df = spark.createDataFrame([("s", _d(f"2000-01-0{i + 1}"), v) for i, v in enumerate(states)],
                               "station string, date date, v int")
    st = windows.state_streaks(df, F.col("v"))
    summ = windows.streak_summary(st).orderBy("start").collect()
    assert [r["length"] for r in summ] == [2, 3, 1, 1]
    assert sum(r["length"] for r in summ) == len(states)
    assert [r["streak_len"] for r in st.orderBy("date").collect()] == [1, 2, 1, 2, 3, 1, 1]


def test_rolling_mean_min_periods(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "station string, date int, x double")
    out = [r["x_rolling"] for r in windows.rolling_mean(df, "x", rows=4, min_periods=3).orderBy("date").collect()]
    assert out[:2] == [None, None] and out[2] == 1.0 and out[9] == 7.5


def test_monthly_total_all_null_is_zero(spark):
    df = spark.createDataFrame([("s", "t", "m", "2000", "Jan", None), ("s", "t", "m", "2000", "Jan", None)],
                               "station string, year_type string, metric_name string, year_for_dash string, "
                               "month string, metric_value double")
    assert agg.monthly_totals(df).first()["total"] == 0.0   # Q3


def test_yearly_needs_12_months(spark):
    rows = [("s", "t", "m", "2000", m, 1.0) for m in ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug",
                                                     "Sep", "Oct", "Nov"]]
    df = spark.createDataFrame(rows, "station string, year_type string, metric_name string, year_for_dash string, "
                                     "month string, total double")
    assert agg.yearly_totals(df).count() == 0               # year with 11 months


def _silver(spark):
    rows = []
    d = _d("1999-12-25")
    for i in range(500):
        day = d + dt.timedelta(days=i)
        rows.append(("s", day, float(i % 5), float(i % 3) if i % 4 else None, 0.0, 20.0, 40.0))
    raw = spark.createDataFrame(rows, "station string, date date, precip double, snow double, snow_depth double, "
                                      "tempmin double, tempmax double")
    return build_precip_silver(raw)


def test_ytd_last_value_equals_year_total(spark):
    long = normals.precip_long(_silver(spark))
    ytd = accumulate.year_to_date(long, out_col="ytd")
    last = (ytd.filter((F.col("year_type") == "calendar_year") & (F.col("year_for_dash") == "2000"))
            .groupBy("metric_name").agg(F.max_by("ytd", "date").alias("last"),
                                        F.sum(F.coalesce("metric_value", F.lit(0.0))).alias("tot")))
    for r in last.collect():
        assert abs(r["last"] - r["tot"]) < 1e-9


def test_incomplete_years_missing_start(spark):
    long = normals.precip_long(_silver(spark))
    bad = {(r["year_type"], r["year_for_dash"]) for r in normals.incomplete_years(long).collect()}
    assert ("calendar_year", "1999") in bad and ("calendar_year", "2000") not in bad
    assert ("water_year", "2000") in bad      # starts Dec 25, not Oct 1


def test_percentile_bands_ordered(spark):
    s = _silver(spark)
    out = normals.mtd_normals(s, mode="trailing").collect()
    for r in out:
        vals = [r[f"p{p}_precip_mtd"] for p in (10, 25, 50, 75, 90)]
        if None not in vals:
            assert vals == sorted(vals)


def test_stack_calendars_one_scan(spark):
    st = reshape.stack_calendars(_silver(spark), mode="decade")
    assert st.count() == 3 * 500
    plan = st._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 2


def _plain(df, keys, order):
    from pyspark.sql import Window
    return Window.partitionBy(*keys).orderBy(order)


def test_segmented_windows_match_plain_windows(spark):
    import random
    random.seed(11)
    start = dt.date(1995, 11, 1)
    rows = []
    for st in ("a", "b"):
        day = start
        for i in range(1400):
            day = day + dt.timedelta(days=random.choice([1, 1, 1, 2, 5, 40]))
            rows.append((st, day, random.choice([0, 0, 1]), None if i % 50 == 0 else float(random.randint(0, 9))))
    df = spark.createDataFrame(rows, "station string, date date, wet int, x double")
    w = _plain(df, ["station"], "date")
    # gaps
    ref = (df.filter("wet = 1").withColumn("g", F.datediff("date", F.lag("date").over(w)) - 1)
           .select("station", "date", "g").collect())
    got = windows.gap_since_previous(df, F.col("wet") == 1, out_col="g").select("station", "date", "g").collect()
    assert sorted(map(tuple, ref), key=str) == sorted(map(tuple, got), key=str)
    # rolling mean
    wr = w.rowsBetween(-364, 0)
    ref = df.withColumn("r", F.when(F.count("x").over(wr) >= 180, F.avg("x").over(wr))).select("station", "date", "r")
    got = windows.rolling_mean(df, "x", out_col="r").select("station", "date", "r")
    a = {(r[0], r[1]): r[2] for r in ref.collect()}
    b = {(r[0], r[1]): r[2] for r in got.collect()}
    assert a.keys() == b.keys()
    assert all((a[k_] is None and b[k_] is None) or abs(a[k_] - b[k_]) < 1e-9 for k_ in a)
    # streaks: island lengths partition the rows and match a plain gaps-and-islands
    st = windows.state_streaks(df, F.col("wet")).select("station", "date", "streak_id", "streak_len")
    chg = F.when(F.lag("wet").over(w).eqNullSafe(F.col("wet")), 0).otherwise(1)
    ref = df.withColumn("c", chg).withColumn("sid", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ref = ref.withColumn("len", F.row_number().over(Window.partitionBy("station", "sid").orderBy("date")))
    a = {(r["station"], r["date"]): (r["sid"], r["len"]) for r in ref.collect()}
    b = {(r["station"], r["date"]): (r["streak_id"], r["streak_len"]) for r in st.collect()}
    assert a == b



def test_fill_daily_spine(spark):
    df = spark.createDataFrame([("a", _d("2000-02-27"), 1.0), ("a", _d("2000-03-02"), 2.0), ("b", _d("2000-01-01"), 3.0)],
                               "station string, date date, precip double")
    out = reshape.fill_daily_spine(df, fill={"precip": 0.0}).orderBy("station", "date").collect()
    a = [(r["date"], r["precip"]) for r in out if r["station"] == "a"]
    assert [d for d, _ in a] == [_d("2000-02-27"), _d("2000-02-28"), _d("2000-02-29"), _d("2000-03-01"), _d("2000-03-02")]
    assert [p for _, p in a] == [1.0, 0.0, 0.0, 0.0, 2.0]
    assert [(r["date"], r["precip"]) for r in out if r["station"] == "b"] == [(_d("2000-01-01"), 3.0)]


def test_streaks_null_states_one_island_first_row_starts_island_one(spark):
    states = [None, None, 1, None, 0, 0]
    df = spark.createDataFrame([("s", _d(f"2000-01-0{i + 1}"), v) for i, v in enumerate(states)],
                               "station string, date date, v int")
    out = windows.state_streaks(df, F.col("v")).orderBy("date").collect()
    assert [r["streak_id"] for r in out] == [1, 1, 2, 3, 4, 4]
    assert [r["streak_len"] for r in out] == [1, 2, 1, 1, 1, 2]


def test_segmented_windows_with_a_hot_station(spark):
    import random
    random.seed(21)
    rows = []
    for st, n in (("hot", 6000), ("c1", 300), ("c2", 300)):
        day = dt.date(1980, 1, 1)
        for i in range(n):
            day = day + dt.timedelta(days=random.choice([1, 1, 2, 3]))
            rows.append((st, day, random.choice([0, 1]), float(random.randint(0, 50))))
    df = spark.createDataFrame(rows, "station string, date date, wet int, x double")
    w = Window.partitionBy("station").orderBy("date")
    ref_gap = {(r[0], r[1]): r[2] for r in df.filter("wet = 1").select(
        "station", "date", (F.datediff("date", F.lag("date").over(w)) - 1).alias("g")).collect()}
    got_gap = {(r[0], r[1]): r[2] for r in windows.gap_since_previous(df, F.col("wet") == 1, out_col="g")
               .select("station", "date", "g").collect()}
    assert ref_gap == got_gap
    wr = w.rowsBetween(-364, 0)
    ref_roll = {(r[0], r[1]): r[2] for r in df.select(
        "station", "date", F.when(F.count("x").over(wr) >= 180, F.avg("x").over(wr)).alias("r")).collect()}
    got_roll = {(r[0], r[1]): r[2] for r in windows.rolling_mean(df, "x", out_col="r")
                .select("station", "date", "r").collect()}
    assert ref_roll.keys() == got_roll.keys()
    assert all((ref_roll[k] is None and got_roll[k] is None) or abs(ref_roll[k] - got_roll[k]) < 1e-9 for k in ref_roll)
