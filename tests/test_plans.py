"""Plan assertions: the physical plans we want at scale."""

import re

from climo.operators import ranks
from climo.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_flagship(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["doy_record_highs"](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    import __spark_entry__ as E
    plan = _plan(fx.daily_precip_raw(spark, SF_SMALL))
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert [sorted(c.split("#")[0] for c in x.split(",")) for x in read] == [
        ["l_discount", "l_linestatus", "l_quantity", "l_returnflag", "l_shipdate", "l_suppkey"]]
    plan = _plan(E.queries()["hourly_density"](spark, SF_SMALL))
    assert "FileScan parquet" in plan and "ExistingRDD" not in plan


def _windows(df):
    """Partition columns of every window in the optimized plan, with what the window stands on."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Window \[[^\n]*?\], \[([^\]]*)\]", text)


def test_no_station_wide_window_over_hourly_rows(spark):
    import __spark_entry__ as E
    for name in ("hourly_density", "wind_rose"):
        own = [w for w in _windows(E.queries()[name](spark, SF_SMALL)) if re.fullmatch(r"station#\d+", w.strip())]
        assert len(own) == (1 if name == "wind_rose" else 0), (name, own)      # the rose's shares: a few rows per station


def test_top_n_uses_group_limit_and_take_ordered(spark):
    t = fx.daily_temps(spark, SF_SMALL)
    part = ranks.top_n_with_ties(t, ["station"], "max_temp", 5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "WindowGroupLimit" in _plan(part)
        assert _plan(part).count("WindowGroupLimit") >= 2          # partial (map side) + final
        glob = ranks.top_n_with_ties(t, [], "max_temp", 5)
        assert "WindowGroupLimit" in _plan(glob)
        dist = ranks.top_n_with_ties(t, [], "max_temp", 5, method="distinct")
        assert "TakeOrderedAndProject" in _plan(dist)
        assert "TakeOrderedAndProject" in _plan(ranks.top_k(t, "max_temp", 10))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_normals_join_is_broadcast_at_run_time(spark):
    import __spark_entry__ as E
    df = E.queries()["departure_month_mean"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_no_single_partition_window_over_facts(spark):
    import __spark_entry__ as E
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ["dry_gaps", "precip_streaks", "rolling_mean_365", "temp_records", "daily_precip_records",
                     "doy_record_highs", "ytd_normals", "mtd_normals"]:
            plan = _plan(E.queries()[name](spark, SF_SMALL))
            assert "SinglePartition" not in plan, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_station_days_are_dealt_by_counted_partitions(spark, monkeypatch):
    import datetime
    import os
    import tempfile
    monkeypatch.setattr(fx, "PARTITION_ROWS", 10)
    d = tempfile.mkdtemp(prefix="run-")
    rows = [(i % 7 if i % 5 else None, datetime.datetime(2001, 1, 1 + i % 20), float(i % 9), "R", "O", 0.05) for i in range(165)]
    names = "l_suppkey long, l_shipdate timestamp, l_quantity double, l_returnflag string, l_linestatus string, l_discount double"
    spark.createDataFrame(rows, names).write.parquet(os.path.join(d, "lineitem.parquet"))
    assert fx.daily_precip_raw(spark, d).rdd.getNumPartitions() == 17
    assert fx.daily_precip_raw(spark, d).groupBy().sum("precip").first()[0] == sum(r[2] for r in rows)


def test_melted_rows_keep_their_partitions(spark):
    from climo.operators import reshape
    wide = spark.range(20).selectExpr("id % 3 AS station", "id", "id * 2 AS a", "null AS b").repartition(3, "station")
    long = reshape.unpivot_metrics(wide, ["station", "id"], ["a", "b"])
    assert _plan(long.groupBy("station", "metric_name").count()).count("Exchange hashpartitioning") == 1
    assert {(r.metric_name, r.metric_value) for r in long.where("id = 4").collect()} == {("a", 8.0), ("b", None)}
