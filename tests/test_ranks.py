import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from climo.operators import ranks


def _brute(rows, n, asc):
    """rank(method='min') ≤ n per group, NULLs unranked."""
    out = set()
    groups = {}
    for g, v, i in rows:
        if v is not None:
            groups.setdefault(g, []).append((v, i))
    for g, vals in groups.items():
        for v, i in vals:
            better = sum(1 for w, _ in vals if (w < v if asc else w > v))
            if better + 1 <= n:
                out.add((g, v, i, better + 1))
    return out


def test_top_n_with_ties_matches_brute_force(spark):
    random.seed(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{i % 7}"      # one group holds a third of the rows
        v = None if i % 97 == 0 else float(random.randint(0, 40))
        rows.append((g, v, i))
    df = spark.createDataFrame(rows, "g string, v double, i long")
    for method in ("window", "distinct"):
        for asc in (False, True):
            got = ranks.top_n_with_ties(df, ["g"], "v", 5, ascending=asc, method=method)
            assert {tuple(r) for r in got.select("g", "v", "i", "rank").collect()} == _brute(rows, 5, asc)
            glob = ranks.top_n_with_ties(df, [], "v", 5, ascending=asc, method=method).select("v", "i", "rank")
            expect = {(v, i, r) for _, v, i, r in _brute([("all", v, i) for _, v, i in rows], 5, asc)}
            assert {tuple(r) for r in glob.collect()} == expect


def test_rank_over_nulls_unranked(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", 1.0), ("a", None)], "g string, v double")
    out = sorted(ranks.rank_over(df, ["g"], "v", ascending=False).select("v", "rank").collect(),
                 key=lambda r: (r[0] is None, r[0]))
    assert [(r[0], r[1]) for r in out] == [(1.0, 3), (3.0, 1), (3.0, 1), (None, None)]


def test_average_rank_floor(spark):
    # pandas average ranks: 10 → 1, 8,8 → 2.5, 5 → 4 ; truncated → 1, 2, 2, 4
    df = spark.createDataFrame([("a", 10.0), ("a", 8.0), ("a", 8.0), ("a", 5.0)], "g string, v double")
    out = sorted(ranks.average_rank_floor(df, ["g"], "v", ascending=False).select("v", "rank").collect(),
                 key=lambda r: -r[0])
    assert [r[1] for r in out] == [1, 2, 2, 4]


def test_head_with_rank_keeps_first_n(spark):
    df = spark.createDataFrame([("s", float(d), f"2000-01-{d:02d}") for d in [5, 3, 3, 9, 1]],
                               "station string, doy double, date string")
    out = ranks.head_with_rank(df, "doy", 3, ascending=True, partition_cols=["station"]).collect()
    assert sorted((r["doy"], r["rank"]) for r in out) == [(1.0, 1), (3.0, 2), (3.0, 2)]


def test_doy_rank_bounded_partition(spark):
    df = spark.createDataFrame([("s", 1.0, 2000, 5.0), ("s", 1.0, 2001, 7.0), ("s", 2.0, 2000, 1.0)],
                               "station string, day_of_year double, year int, max_temp double")
    out = {(r["day_of_year"], r["year"]): r["hr"] for r in
           ranks.doy_rank(df, "max_temp", ascending=False, rank_col="hr").collect()}
    assert out == {(1.0, 2000): 2, (1.0, 2001): 1, (2.0, 2000): 1}


def test_top_n_large_n_falls_back_to_distinct(spark):
    df = spark.createDataFrame([("g", float(i % 50), i) for i in range(300)], "g string, v double, i long")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        out = ranks.top_n_with_ties(df, ["g"], "v", 20, ascending=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" not in plan or "HashAggregate" in plan
        assert out.count() == 24          # values 0..3 (ranks 1, 7, 13, 19), 6 ties each
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
