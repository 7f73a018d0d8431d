"""OLS by merged factors against a full-design solve, models as cubic pieces against the basis, cross-validation folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from climo.functions.student_t import two_sided_p
from climo.operators import least_squares as ls
from climo.operators import regression as rg
from climo.plans import catalog
from tests.conftest import SF_MID


def full_fit(pdf, y, terms):
    """One key's fit on its whole design, centred on the design's own means: (coef, std_err, p, fitted, parts)."""
    own = []
    for t in terms:
        if t.kind in rg.SPLINE_KINDS:
            t = rg.replace_knots(t, rg.knots_from_values(pdf[t.col], t.df, t.lower, t.upper, t.center, t.kind != "cr"))
        own.append(t)
    x = rg.design(pdf, own)
    to = rg.centering_transform(own, x.mean(axis=0))
    z = x @ to
    seen = np.abs(z).sum(axis=0) > 0
    q, r = np.linalg.qr(z[:, seen])
    beta, obs = np.zeros(z.shape[1]), pdf[y].to_numpy(dtype=float)
    full = np.linalg.matrix_rank(z[:, seen]) == seen.sum()
    beta[seen] = np.linalg.solve(r, q.T @ obs) if full else np.linalg.lstsq(z[:, seen], obs, rcond=None)[0]
    resid = obs - z @ beta
    dof = len(pdf) - np.linalg.matrix_rank(z[:, seen])
    s2 = resid @ resid / dof if dof else np.nan
    err = np.full(z.shape[1], np.nan)
    if full and dof:
        inv = np.linalg.inv(r)
        err[seen] = np.sqrt(s2 * (inv ** 2).sum(axis=1))
    raw = to @ beta
    parts = [x[:, sl] @ raw[sl] for sl in rg.term_slices(own)]
    return seen, beta, err, z @ beta, parts, full and dof > 0


@pytest.mark.parametrize("model", ["trend", "spline", "hourly"])
def test_equals_full_design_on_every_station(spark, model):
    if model == "hourly":
        df, y, terms, part = catalog._hourly_model_frame(spark, SF_MID), "temp", catalog._hourly_terms(), F.year("timestamp")
    else:
        df, y, part = catalog._seasonal_frame(spark, SF_MID), "avg_temp", F.year("date")
        terms = catalog._trend_terms() if model == "trend" else [rg.intercept(), rg.cr("total_years", 3), rg.cc("doy_frac", 12)]
    df = df.cache()
    fits = {r.station: r for r in ls.ols_fit(df, y, terms, part=part).collect()}
    other = {r.station: r for r in ls.ols_fit(df.orderBy(F.rand(3)), y, terms).collect()}       # other parts, other order
    rows = ls.predict(df, ls.ols_fit(df, y, terms, part=part), terms, components=True).toPandas()
    names = [f"comp_{t.name}" for t in terms]
    stations = df.toPandas().groupby("station")
    assert len(stations) == len(fits) == (5 if model == "hourly" else 25)
    on = [c for c in df.columns]
    checked = 0
    for station, pdf in stations:
        seen, beta, err, fitted, parts, regular = full_fit(pdf, y, terms)
        got = fits[station]
        assert got.n == len(pdf)
        merged = pdf[on].merge(rows, on=[c for c in on if c != y], how="left")
        assert np.allclose(merged["fitted"], fitted, rtol=1e-8, atol=1e-8 * np.abs(fitted).max())
        assert np.allclose(merged[names].sum(axis=1), merged["fitted"], rtol=1e-9)
        if regular:
            checked += 1
            coef = np.array([np.nan if v is None else v for v in got.coef])
            assert list(~np.isnan(coef)) == list(seen)
            assert np.allclose(coef[seen], beta[seen], rtol=1e-7, atol=1e-7 * np.abs(beta).max())
            se = np.array([np.nan if v is None else v for v in got.std_err])
            assert np.allclose(se[seen], err[seen], rtol=1e-6)
            p = np.array([np.nan if v is None else v for v in got.p_value])
            assert np.allclose(p[seen], rg.t_two_sided_p(beta[seen] / err[seen], len(pdf) - seen.sum()), rtol=1e-5, atol=1e-10)
            assert np.allclose(np.array(got.beta_raw), np.array(other[station].beta_raw), rtol=1e-7, atol=1e-7 * np.abs(beta).max())
            for part_, name in zip(parts, names, strict=True):
                assert np.allclose(merged[name], part_, rtol=1e-7, atol=1e-7 * np.abs(fitted).max())
    assert checked >= len(fits) // 2


def test_cancellation_free_residuals(spark):
    """A tiny residual under a large level: sums of squares would lose it."""
    rng = np.random.default_rng(2)
    t = np.arange(3000.0)
    pdf = pd.DataFrame({"station": "s", "t": t, "y": 1e6 + 3.0 * t + rng.normal(0, 1e-4, t.size)})
    r = ls.ols_fit(spark.createDataFrame(pdf), "y", [rg.intercept(), rg.linear("t")]).first()
    assert abs(r.sigma2 ** 0.5 - 1e-4) < 1e-5 and abs(r.coef[1] - 3.0) < 1e-8


def test_pieces_equal_the_basis():
    rng = np.random.default_rng(1)
    for cyclic in (True, False):
        knots = np.array([0.0, 1.0, 2.5, 2.75, 6.0])
        values = rng.normal(size=4 if cyclic else 5)
        x = np.concatenate([knots, rng.uniform(0, 6, 200), [] if cyclic else rng.uniform(-5, 12, 50)])
        want = rg.spline_basis(x, knots, cyclic) @ values
        got = np.zeros(x.size)
        for lo, hi, at, *c in ls.cubic_pieces(knots, values, cyclic):
            here = (x >= lo) & (x < hi)
            u = x[here] - at
            got[here] = c[0] + u * (c[1] + u * (c[2] + u * c[3]))
        assert np.allclose(got, want)


def test_edge_cases(spark):
    schema = "station string, x double, m string, y double"
    rows = [("a", float(i), "Jan" if i % 2 else "Feb", float(i * i % 7)) for i in range(40)]
    rows += [("one", 5.0, "Jan", 2.0), ("same", 3.0, "Jan", 1.0), ("same", 3.0, "Jan", 2.0), (None, 1.0, "Jan", 1.0), (None, 2.0, "Jan", 2.0),
             (None, 4.0, "Feb", 3.0), ("a", None, "Jan", 1.0), ("a", 2.0, None, 1.0), ("a", 2.0, "Jan", None), ("empty", 1.0, "Jan", None)]
    df = spark.createDataFrame(rows, schema)
    terms = [rg.intercept(), rg.cr("x", 3), rg.dummies("m", ["Jan", "Feb", "Mar"])]
    fit = ls.ols_fit(df, "y", terms)
    by = {r.station: r for r in fit.collect()}
    assert set(by) == {"a", "one", "same", None} and by["a"].n == 40
    assert by["a"].coef[-1] is None                                     # no March
    assert by["one"].rank == 1 and by["one"].sigma2 is None and by["one"].p_value[0] is None
    out = ls.predict(df, fit, terms).collect()
    assert len(out) == len(rows)
    fitted = {(r.station, r.x, r.m): r.fitted for r in out}
    assert fitted["a", None, "Jan"] is None and fitted["a", 2.0, None] is None and fitted["empty", 1.0, "Jan"] is None
    assert abs(fitted["same", 3.0, "Jan"] - 1.5) < 1e-9 and abs(fitted["one", 5.0, "Jan"] - 2.0) < 1e-9
    assert abs(fitted[None, 1.0, "Jan"] - 1.0) < 1e-6                   # null keys are a key
    assert ls.ols_fit(df.limit(0), "y", terms).count() == 0


def test_model_plan_has_no_python_over_facts(spark, capsys):
    h = catalog._hourly_model_frame(spark, SF_MID)
    ls.predict(h, catalog._hourly_fit(h), catalog._hourly_terms()).explain("simple")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_folds_equal_refitting(spark):
    rng = np.random.default_rng(7)
    grid = rg.DOY_GRID
    for drop in (0.0, 0.6):
        doys, years, values = [], [], []
        for year in range(2000, 2006):
            for d in grid:
                if rng.random() >= drop:
                    doys.append(d)
                    years.append(year)
                    values.append([float(v) for v in np.sin(d / 58) + rng.normal(size=1 + (rng.random() < 0.1))])
        doys, years = np.array(doys), np.array(years)
        got = rg.fold_errors(doys, years, np.array([len(v) for v in values], float), np.array([sum(v) for v in values]), values, [2, 5, 24])
        flat_d = np.repeat(doys, [len(v) for v in values])
        flat_y, flat_v = np.repeat(years, [len(v) for v in values]), np.concatenate(values)
        for k, year, mae in got:
            x = rg.spline_basis(flat_d, rg.knots_from_values(doys, k, upper=366.0), True)
            held = flat_y == year
            beta, *_ = np.linalg.lstsq(x[~held], flat_v[~held], rcond=None)
            assert abs(mae - np.mean(np.abs(x[held] @ beta - flat_v[held]))) < 1e-9
        assert len(got) == 3 * 6


def test_cv_select_df_on_every_station(spark):
    out = catalog.QUERIES["cv_select_df"](spark, SF_MID).toPandas()
    assert len(out) == 25 * 23 and out["mae"].notna().all() and out.groupby("station")["df"].nunique().eq(23).all()


def test_p_value_column(spark):
    rows = [(t, v) for t in (0.0, 0.1, -0.7, 1.3, 2.5, 8.0, 30.0) for v in (1, 2, 3, 4, 11, 58, 1999, 2000, 2001, 50_000)]
    got = spark.createDataFrame([(float(t), v) for t, v in rows], "t double, v long").withColumn("p", two_sided_p(F.col("t"), F.col("v"))).collect()
    want = rg.t_two_sided_p(np.array([r.t for r in got]), np.array([float(r.v) for r in got]))
    assert np.allclose([r.p for r in got], want, rtol=0, atol=1e-10)
    odd = spark.createDataFrame([(1.0, 0), (None, 3), (1.0, None)], "t double, v long").withColumn("p", two_sided_p(F.col("t"), F.col("v")))
    assert [r.p for r in odd.collect()] == [None, None, None]


def test_normals_equal_a_full_fit(spark):
    """M4, M5: every station's curves and bands against a fit on its own rows."""
    from climo.functions import calendar as cal
    from climo.sources import fixtures as fx
    d = fx.daily_temps(spark, SF_MID).where(F.year("date").between(*catalog._NORMAL_YEARS)).withColumn("doy", cal.doy_index("date")).toPandas()
    out = rg.daily_normals(fx.daily_temps(spark, SF_MID), catalog._NORMAL_YEARS, dp=None).toPandas()
    assert out.groupby("station").size().eq(366).all() and out["station"].nunique() == 25

    def curve(x, y, df):
        knots = rg.knots_from_values(x, df, upper=366.0)
        beta, *_ = np.linalg.lstsq(rg.spline_basis(x, knots, True), y, rcond=None)
        return rg.spline_basis(rg.DOY_GRID, knots, True) @ beta

    for station, pdf in d.groupby("station"):
        got = out[out.station == station].sort_values("day_of_year")
        for metric, name, df in (("max_temp", "normal_high", 7), ("min_temp", "normal_low", 6), ("avg_temp", "normal_temp", 5)):
            assert np.allclose(got[name], curve(pdf["doy"].to_numpy(), pdf[metric].to_numpy(), df), rtol=1e-7)
        for metric in ("max_temp", "min_temp"):
            for p in (0.1, 0.9):
                band = pdf.groupby("doy")[metric].quantile(p)
                assert np.allclose(got[f"{metric}_p{int(p * 100)}"], curve(band.index.to_numpy(), band.to_numpy(), 6), rtol=1e-7)


def test_fits_without_splines_are_batched(spark, capsys):
    """One read of the facts, and the same fits however the sorted rows fall into batches; null keys are a key."""
    catalog.QUERIES["trend_plus_month_effects"](spark, SF_MID).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "InPandas" not in plan and "Join" not in plan
    rng = np.random.default_rng(5)
    rows = [(s, p, "ab"[i % 2], float(i), float(rng.normal())) for s, size in (("x", 3), ("y", 41), (None, 29), ("z", 1)) for p in (1, 2) for i in range(size)]
    df = spark.createDataFrame(rows, "station string, part int, m string, t double, y double")
    terms = [rg.intercept(), rg.dummies("m", ["a", "b", "c"]), rg.linear("t")]
    one = {r.station: r for r in ls.ols_fit(df, "y", terms, part=F.lit(0.0)).collect()}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        few = {r.station: r for r in ls.ols_fit(df, "y", terms, part=F.col("part")).collect()}
        fitted = ls.predict(df, ls.ols_fit(df, "y", terms), terms).toPandas()
    finally:
        spark.conf.set(size, before)
    assert set(one) == set(few) == {"x", "y", "z", None}
    for station, r in one.items():
        own = [row for row in rows if row[0] == station]
        design = np.array([[1.0, row[2] == "b", 0.0, row[3]] for row in own])
        beta = np.linalg.lstsq(design, np.array([row[4] for row in own]), rcond=None)[0]
        for got in (r, few[station]):
            assert got.n == len(own) and got.rank == np.linalg.matrix_rank(design) and got.coef[2] is None
            assert np.allclose(got.beta_raw, beta, atol=1e-9)
            assert [p.c0 for p in got.pieces] == got.beta_raw[1:3] and got.constants == [got.beta_raw[0], None, got.beta_raw[3]]
        here = fitted[fitted.station.isna() if station is None else fitted.station == station]
        assert np.allclose(here["fitted"].sort_values(), np.sort(design @ beta), atol=1e-9)
