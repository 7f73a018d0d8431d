import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climo.sources import fixtures as fx
from climo.streaming import read_current, start_landing_upsert
from climo.streaming.landing_upsert import latest_version, merge_batch
from tests.conftest import SF_SMALL

FIELDS = ["DATE", "STATION", "PRCP", "SNOW", "TMIN", "TMAX"]


def _payload(rows, null_snow=False):
    return [{"DATE": r["date"].isoformat() + "T00:00:00", "STATION": r["station"], "PRCP": str(r["precip"]),
             "SNOW": None if (null_snow or r["snow"] is None) else str(r["snow"]),
             "TMIN": str(r["tempmin"]), "TMAX": str(r["tempmax"])} for r in rows]


def test_stream_upsert_two_batches(spark):
    raw = fx.daily_precip_raw(spark, SF_SMALL).filter(F.col("station").isin("1", "2")).orderBy("station", "date")
    rows = raw.collect()
    half = len(rows) // 2
    base = tempfile.mkdtemp(prefix="climo-stream-")
    landing, table, ckpt = (os.path.join(base, x) for x in ("landing", "table", "ckpt"))
    os.makedirs(landing)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS])

    with open(os.path.join(landing, "a.json"), "w") as f:
        json.dump(_payload(rows[:half + 10]), f)
    q = start_landing_upsert(spark, landing, schema, table, ckpt)
    q.awaitTermination()
    # second batch overlaps by 10 rows with snow missing: stored snow must survive
    with open(os.path.join(landing, "b.json"), "w") as f:
        json.dump(_payload(rows[half:half + 10], null_snow=True) + _payload(rows[half + 10:]), f)
    q = start_landing_upsert(spark, landing, schema, table, ckpt)
    q.awaitTermination()

    cur = read_current(spark, table)
    assert cur.count() == len(rows)
    got = {(r["station"], r["date"]): r["snow"] for r in cur.collect()}
    for r in rows:
        assert got[(r["station"], r["date"])] == r["snow"]


def test_retried_batch_is_not_merged_twice(spark):
    table = os.path.join(tempfile.mkdtemp(prefix="climo-retry-"), "t")
    one = spark.createDataFrame([("s", 1.0)], "station string, x double")
    two = spark.createDataFrame([("s", 2.0), ("t", None)], "station string, x double")
    assert merge_batch(one, table, "stream a", 0, ["station"]) == 1
    assert merge_batch(two, table, "stream a", 1, ["station"]) == 2
    assert merge_batch(one, table, "stream a", 0, ["station"]) is None          # epoch 0 repeated after a failure
    assert {r["station"]: r["x"] for r in read_current(spark, table).collect()} == {"s": 2.0, "t": None}
    two.write.parquet(os.path.join(table, "v=3"))                               # written, never committed
    assert latest_version(spark, table) == 2
    assert merge_batch(spark.createDataFrame([("t", 5.0)], "station string, x double"), table, "stream a", 2, ["station"]) == 3
    assert {r["station"]: r["x"] for r in read_current(spark, table).collect()} == {"s": 2.0, "t": 5.0}


def test_new_checkpoint_goes_on_from_the_stored_table(spark):
    base = tempfile.mkdtemp(prefix="climo-fresh-")
    landing, table = os.path.join(base, "landing"), os.path.join(base, "table")
    os.makedirs(landing)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS])

    def land(name, days, prcp):
        with open(os.path.join(landing, name), "w") as f:
            json.dump([{"DATE": f"2020-01-0{d}", "STATION": "s", "PRCP": str(prcp), "SNOW": "0", "TMIN": "1", "TMAX": "2"} for d in days], f)

    land("a.json", (1, 2), 1.0)
    start_landing_upsert(spark, landing, schema, table, os.path.join(base, "first")).awaitTermination()
    os.makedirs(os.path.join(base, "landing2"))
    landing = os.path.join(base, "landing2")
    land("b.json", (3, 3), 7.0)                                                 # one key twice in a batch
    start_landing_upsert(spark, landing, schema, table, os.path.join(base, "second")).awaitTermination()
    assert sorted(str(r["date"]) for r in read_current(spark, table).collect()) == ["2020-01-01", "2020-01-02", "2020-01-03"]


def test_read_errors_are_raised(spark):
    base = tempfile.mkdtemp(prefix="climo-broken-")
    os.makedirs(os.path.join(base, "_commits"))
    with open(os.path.join(base, "_commits", "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        read_current(spark, base)
    assert read_current(spark, os.path.join(base, "nothing")) is None
