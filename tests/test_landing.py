"""Quarantine of broken records, partition-wise upserts that leave other files alone, globally sorted tables, automatic bins."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climo.operators import aggregates, normals, windows
from climo.sources import ingest, landing

SCHEMA = T.StructType([T.StructField("station", T.StringType()), T.StructField("date", T.DateType()), T.StructField("precip", T.DoubleType())])

def parts():
    return {"year": F.year("date"), "month": F.month("date")}


def test_csv_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station,date,precip\ns1,2020-01-01,0.5\ns1,not a date,1.0\ns1,2020-01-03,\ns1,2020-01-04,NaN\n")
    (tmp_path / "b.csv").write_text("station,date,precip\ns2,2020-01-01,x\ns2,2020-01-02,2,extra,fields\n,2020-01-05,1\n")
    (tmp_path / "c.csv").write_text("")
    got = landing.read_landing(spark, [str(tmp_path / f"{x}.csv") for x in "abc"], SCHEMA, rename={"precip": "rain"})
    rows = sorted((r.station or "", str(r.date), r.rain) for r in got.rows.collect())
    assert rows == [("", "2020-01-05", 1.0), ("s1", "2020-01-01", 0.5), ("s1", "2020-01-03", None), ("s1", "2020-01-04", None)]
    bad = {(os.path.basename(r.source_file), r.record) for r in got.rejected.collect()}
    assert bad == {("a.csv", "s1,not a date,1.0"), ("b.csv", "s2,2020-01-01,x"), ("b.csv", "s2,2020-01-02,2,extra,fields")}
    kept = landing.quarantined(got, str(tmp_path / "quarantine"))
    assert kept.count() == 3
    assert got.rows.count() == 4                                        # the column pruned scan sees the same records


def test_json_quarantine(spark, tmp_path):
    lines = [json.dumps({"station": "s", "date": "2020-01-02", "precip": 1.5}), '{"station": "s", "date": ', json.dumps({"station": "t"}), "oops"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    got = landing.read_landing(spark, str(tmp_path / "a.json"), SCHEMA, "json")
    assert sorted((r.station, str(r.date), r.precip) for r in got.rows.collect()) == [("s", "2020-01-02", 1.5), ("t", "None", None)]
    assert {r.record for r in got.rejected.collect()} == {lines[1], lines[3]}


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_rewrites_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(s, f"202{y}-{m:02d}-05", float(m), None if m == 3 else 1.0) for s in "ab" for y in (0, 1) for m in range(1, 13)]
    schema = "station string, date string, precip double, snow double"
    table = spark.createDataFrame(rows, schema).withColumn("date", F.to_date("date"))
    ingest.write_table(table.withColumns(parts()), path, partition_by=list(parts()))
    before = _files(path)
    batch = spark.createDataFrame([("a", "2020-03-05", 9.0, 7.0), ("b", "2020-03-05", None, 2.0), ("c", "2022-07-01", 3.0, None)], schema)
    batch = batch.withColumn("date", F.to_date("date"))
    want = sorted(map(str, ingest.upsert_coalesce(table, batch).collect()))
    assert landing.merge_partitions(batch, path, parts()) == [(2020, 3), (2022, 7)]
    after = _files(path)
    touched = {f for f in {*before, *after} if before.get(f) != after.get(f)}
    assert touched and all(f.startswith(("year=2020/month=3/", "year=2022/month=7/")) for f in touched)
    read = lambda: sorted(map(str, spark.read.parquet(path).select(*table.columns).collect()))
    assert read() == want
    landing.merge_partitions(batch, path, parts())                        # again: nothing changes
    assert read() == want
    assert landing.merge_partitions(batch.limit(0), path, parts()) == [] and read() == want


def test_merge_prunes_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "table")
    table = spark.range(48).selectExpr("'s' station", "add_months(date '2020-01-01', int(id)) date", "id precip")
    ingest.write_table(table.withColumns(parts()), path, partition_by=list(parts()))
    label = F.concat_ws("/", *[F.coalesce(F.col(n).cast("string"), F.lit("-")) for n in parts()])
    spark.read.parquet(path).where(label.isin(["2021/4"])).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "2021/4" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_sorted_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "record string, rank int, id long").repartition(7)
    path = str(tmp_path / "sorted")
    landing.write_sorted(df, path, ["record", "rank"])
    assert landing.order_violations(spark, path, ["record", "rank"]) == 0
    got = sorted(landing.sorted_rows(spark, path).collect(), key=lambda r: r.position)
    keys = [(r.record is not None, r.record or "", r["rank"]) for r in got]
    assert [r.position for r in got] == list(range(1, 3001)) and keys == sorted(keys)
    other = str(tmp_path / "unsorted")
    df.write.parquet(other)
    assert landing.order_violations(spark, other, ["record", "rank"]) > 0
    empty = str(tmp_path / "empty")
    landing.write_sorted(df.limit(0), empty, ["record"])
    assert landing.sorted_rows(spark, empty).count() == 0 and landing.order_violations(spark, empty, ["record"]) == 0


def test_automatic_width(spark):
    rows = [("a", float(i)) for i in range(100)] + [("b", 3.0)] * 5 + [("c", 0.0)] * 9 + [("c", 0.9)] + [("d", None)] + [("e", i / 1000) for i in range(8)]
    df = spark.createDataFrame(rows, "station string, v double")
    got = {r.station: r.bin_width for r in aggregates.automatic_width(df, "v", ["station"]).collect()}
    # 2 * 49.5 / cbrt(100) = 21.3; equal values; quartiles equal: 0.9 / 4; 2 * 0.0035 / 2
    assert got == {"a": 50.0, "b": 1.0, "c": pytest.approx(0.5), "e": pytest.approx(0.005)}
    bins = aggregates.histogram_percent(df, "v", None, keys=["station"]).collect()
    assert {r.station for r in bins} == {"a", "b", "c", "e"} and sum(r.n for r in bins if r.station == "a") == 100
    assert aggregates.histogram_percent(df, "v", None).count() >= 1      # no keys: one width for all


def test_order_statistics_and_rolling_mean(spark):
    rows = [("a", [1.0, 2.0, 4.0]), ("b", [5.0]), ("c", [])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    got = {r.k: (r.lo, r.mid) for r in df.select("k", normals.order_statistic(F.col("v"), 0.1).alias("lo"),
                                                 normals.order_statistic(F.col("v"), 0.5).alias("mid")).collect()}
    assert got == {"a": (pytest.approx(1.2), 2.0), "b": (5.0, 5.0), "c": (None, None)}
    rng = random.Random(1)
    values = [None if rng.random() < 0.3 else 1e6 + rng.random() for _ in range(900)]
    daily = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "station string, n int, v double")
    out = windows.rolling_mean(daily.repartition(5), "v", rows=50, min_periods=30, order_col="n").collect()
    for r in out:
        frame = [x for x in values[max(0, r.n - 49):r.n + 1] if x is not None]
        assert r.v_rolling == (pytest.approx(sum(frame) / len(frame), rel=1e-12) if len(frame) >= 30 else None)
