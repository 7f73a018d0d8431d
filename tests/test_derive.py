from pyspark.sql import functions as F

from climo.functions import derive as dv


def test_rain_split_rules_and_null_guard(spark):
    rows = [(10.0, 8.0, 40.0, 50.0), (10.0, 8.0, 10.0, 20.0), (10.0, 8.0, 30.0, 35.0),
            (1.0, 80.0, 30.0, 35.0), (10.0, None, 30.0, 35.0), (None, 1.0, 40.0, 50.0)]
    df = spark.createDataFrame(rows, "p double, s double, tmin double, tmax double")
    out = [r["r"] for r in df.select(dv.rain("p", "s", "tmin", "tmax").alias("r")).collect()]
    assert out[0] == 10.0          # tmin > 37: all rain
    assert out[1] == 0.0           # tmax < 29: no rain
    assert out[2] == 9.0           # mixed: 10 - 8/8
    assert out[3] == 0.0           # clipped at 0
    assert out[4] is None          # Q2: missing snow stays missing
    assert out[5] is None


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(dv.nan_to_null("x")).collect()] == [None, 1.0]


def test_step_bin_and_cut_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (20.0,), (None,), (-1.0,)], "x double")
    sb = [r[0] for r in df.select(dv.step_bin("x", [0, 1, 3], ["0in", "0-1in", "1-3in", "3+in"], "3+in",
                                              null_label="missing")).collect()]
    assert sb == ["0in", "0-1in", "0-1in", "3+in", "missing", "0in"]
    ct = [r[0] for r in df.select(dv.cut("x", [0, 10, 15], ["0-10", "10-15"])).collect()]
    assert ct[0] is None           # Q13: lowest edge excluded
    assert ct[1] == "0-10" and ct[3] is None


def test_compass_sector_half_even(spark):
    df = spark.createDataFrame([(0.0,), (11.25,), (33.75,), (359.0,), (348.75,)], "d double")
    out = [r[0] for r in df.select(dv.compass_sector("d")).collect()]
    assert out == [0.0, 0.0, 45.0, 0.0, 0.0]


def test_anomaly_pct_zero_guard(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 0.0)], "x double, n double")
    out = [r[0] for r in df.select(dv.anomaly_pct("x", "n")).collect()]
    assert out == [100.0, None]
