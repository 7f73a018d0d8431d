"""Record tables (V29-V32): top-N with ties per record family, stacked into
one long table ``(station, rank, date, metric_name, metric_value, month, record)``.

Day-level families are ranked in one pass: each row is tagged (``explode``)
with every family it belongs to and its sort key, and a single
``top_n_with_ties`` over (station, record) ranks them all — a
``WindowGroupLimit`` trims each family inside every map task before the
shuffle.  Season- and year-level families rank small per-season / per-year
tables.  ``date`` is a string label: a date, a year or ``'Mon YYYY'``
depending on the family.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climo.functions import calendar as cal
from climo.operators import aggregates as agg
from climo.operators import ranks, reshape, windows

# ---- fixed values ---------------------------------------------------------
RECORDS_DEFAULT = 15
RECENT_YEARS = 3
# ---------------------------------------------------------------------------

RECORD_COLUMNS = ["rank", "date", "metric_name", "metric_value", "month", "record"]


def _out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.col("rank").cast("int").alias("rank"), F.col("date").cast("string").alias("date"),
                     F.col("metric_name").cast("string").alias("metric_name"),
                     F.col("metric_value").cast("double").alias("metric_value"),
                     F.col("month").cast("string").alias("month"), F.col("record").cast("string").alias("record"))


def _families(rows: DataFrame, fams, keys: Sequence[str], n: int) -> DataFrame:
    """Rank several record families in one pass (U3 as an ``explode`` of
    record tags): every row is tagged once per family it belongs to with the
    family's sort key (value, negated for "largest first"), then one
    ``top_n_with_ties`` over (station, record) ranks all families together.

    ``fams``: list of (record Column, metric_name Column, value Column,
    descending bool, condition Column or None, month Column)."""
    k = list(keys)
    entries = []
    for record, metric, value, desc, cond, month in fams:
        key = F.negative(value) if desc else value
        if cond is not None:
            key = F.when(cond, key)
        entries.append(F.struct(record.alias("record"), metric.alias("metric_name"),
                                value.cast("double").alias("metric_value"), key.cast("double").alias("_key"),
                                month.alias("month")))
    tagged = rows.select(*k, "date", F.explode(F.array(*entries)).alias("_f")).select(*k, "date", "_f.*")
    return ranks.top_n_with_ties(tagged, [*k, "record"], "_key", n, ascending=True)


def temp_records(daily: DataFrame, n: int = RECORDS_DEFAULT, hot: float = 100.0, freeze: float = 32.0,
                 keys: Sequence[str] = ("station",)) -> DataFrame:
    """Hottest / coldest days (overall and per month), coldest maxima,
    hottest minima, years with most hot days, earliest first freezes and
    latest last freezes (complete seasons only, Q5)."""
    k = list(keys)
    d = daily.withColumns({"month": cal.month_label("date"),
                           "season_start": cal.season_start("date"),
                           "snow_day_of_year": cal.doy_index("date", "snow_season")})
    month_tag = lambda base: F.concat(F.lit(base + " ("), F.col("month"), F.lit(")"))
    hi, lo, mo = F.col("max_temp"), F.col("min_temp"), F.col("month")
    mx, mn = F.lit("max_temp"), F.lit("min_temp")
    fams = [
        (month_tag("hottest_day"), mx, hi, True, None, mo),
        (F.lit("hottest_day"), mx, hi, True, None, mo),
        (month_tag("coldest_day"), mn, lo, False, None, mo),
        (F.lit("coldest_day"), mn, lo, False, None, mo),
        (F.lit("coldest_maximum"), mx, hi, False, None, mo),
        (F.lit("hottest_minimum"), mn, lo, True, None, mo),
    ]
    out = _out(_families(d, fams, k, n), k)

    hot_years = (d.groupBy(*k, F.year("date").alias("year"))
                 .agg(F.count_if(F.col("max_temp") >= hot).cast("double").alias("metric_value")))
    hot_years = ranks.top_n_with_ties(hot_years, k, "metric_value", n, ascending=False)
    out = out.unionByName(_out(hot_years.select(
        *k, "rank", F.col("year").alias("date"), F.lit("100 Degree Days").alias("metric_name"),
        "metric_value", F.lit(cal.YEAR_LABEL).alias("month"), F.lit("100_degree_days").alias("record")), k))

    # first / last freeze of each complete season: min_by / max_by per season
    # (one aggregate), then top-N over the season table
    bounds = agg.complete_season_bounds(daily, k)
    frz = d.filter(F.col("min_temp") <= freeze)
    seasons = (frz.groupBy(*k, "season_start")
               .agg(F.min("snow_day_of_year").alias("first_doy"), F.max("snow_day_of_year").alias("last_doy"),
                    F.min_by(F.struct("date", "min_temp"), "snow_day_of_year").alias("first"),
                    F.max_by(F.struct("date", "min_temp"), "snow_day_of_year").alias("last")))
    seasons = reshape.attach_scalars(seasons, bounds, k)
    for col, asc, record, cond in (("first", True, "first_freeze", F.col("season_start") >= F.col("min_season")),
                                   ("last", False, "last_freeze", F.col("season_start") < F.col("max_season"))):
        s_ = seasons.filter(cond).select(*k, F.col(f"{col}_doy").alias("snow_day_of_year"),
                                         F.col(f"{col}.date").alias("date"), F.col(f"{col}.min_temp").alias("min_temp"))
        top = ranks.top_n_with_ties(s_, k, "snow_day_of_year", n, ascending=asc)
        out = out.unionByName(_out(top.select(
            *k, "rank", "date", F.lit("Freeze").alias("metric_name"), F.col("min_temp").alias("metric_value"),
            F.lit(cal.YEAR_LABEL).alias("month"), F.lit(record).alias("record")), k))
    return out


def daily_precip_records(silver: DataFrame, n: int = RECORDS_DEFAULT,
                         keys: Sequence[str] = ("station",)) -> DataFrame:
    """Wettest rain / snow days (per month and overall), longest dry
    gaps between wet days, earliest and latest snow days."""
    k = list(keys)
    r, sn, mo = F.col("rain"), F.col("snow"), F.col("month")
    per_month = lambda m: F.concat(F.lit(m + "iest day ("), mo, F.lit(")"))
    fams = [
        (per_month("rain"), F.lit("rain"), r, True, r > 0, mo),
        (F.lit("rainiest day"), F.lit("rain"), r, True, r > 0, F.lit("ALL")),
        (per_month("snow"), F.lit("snow"), sn, True, sn > 0, mo),
        (F.lit("snowiest day"), F.lit("snow"), sn, True, sn > 0, F.lit("ALL")),
    ]
    wet = silver.filter((r > 0) | (sn > 0))
    out = _out(_families(wet, fams, k, n), k)

    cols = [*k, "date", "month", "year", "season_start"]
    snow = (silver.filter(sn > 0).select(*cols, F.lit("snow").alias("metric_name"), sn.alias("metric_value"))
            .withColumn("day_of_year", cal.doy_index("date", "snow_season")))
    earliest = ranks.head_with_rank(snow, "day_of_year", n, ascending=True, partition_cols=k)
    earliest = earliest.withColumns({"month": F.lit("ALL"), "record": F.lit("earliest_snow")})
    min_year = reshape.per_key_scalars(wet, k, _min_year=F.min("year"))
    late_rows = reshape.attach_scalars(snow, min_year, k).filter(F.col("season_start") >= F.col("_min_year"))
    latest = ranks.head_with_rank(late_rows.drop("_min_year"), "day_of_year", n, ascending=False, partition_cols=k)
    latest = latest.withColumns({"month": F.lit("ALL"), "record": F.lit("latest_snow")})

    gaps = windows.gap_since_previous(silver.select(*k, "date", "precip_day"), F.col("precip_day") == 1, k,
                                      out_col="metric_value")
    dry = (ranks.top_n_with_ties(gaps.filter(F.col("metric_value") > 0), k, "metric_value", n, ascending=False)
           .withColumns({"metric_name": F.lit("precip"), "month": F.lit("ALL"),
                         "record": F.lit("consecutive_days_dry")}))
    for f in (dry, latest, earliest):
        out = out.unionByName(_out(f, k))
    return out


def monthly_precip_records(precip_rank: DataFrame, n: int = RECORDS_DEFAULT,
                           keys: Sequence[str] = ("station",)) -> DataFrame:
    """Rainiest / snowiest months, driest months, most and least snowy
    seasons, rainiest years — from the monthly rank table (V12), all
    families ranked in one pass."""
    k = list(keys)
    yt, mn, mo, tot = F.col("year_type"), F.col("metric_name"), F.col("month"), F.col("total")
    is_year = mo == cal.YEAR_LABEL
    cal_month = (yt == "calendar_year") & ~is_year
    snow_year = (yt == "snow_season") & is_year & (mn == "snow")
    month_year = F.concat(mo, F.lit(" "), F.col("year_for_dash"))
    label = F.col("year_for_dash")
    fams = [  # (record, date label, descending, condition)
        (F.lit("rainiest_month"), month_year, True, cal_month & (mn == "rain")),
        (F.lit("snowiest_month"), month_year, True, cal_month & (mn == "snow")),
        (F.lit("driest_month"), month_year, False, cal_month & (mn == "precip")),
        (F.lit("least_snow_year"), label, False, snow_year),
        (F.lit("most_snow_year"), label, True, snow_year),
        (F.lit("most_rain_year"), label, True, (yt == "calendar_year") & is_year & (mn == "rain")),
    ]
    entries = [F.struct(rec.alias("record"), lab.alias("date"), tot.alias("metric_value"),
                        F.when(cond, F.negative(tot) if desc else tot).alias("_key"))
               for rec, lab, desc, cond in fams]
    tagged = (precip_rank.select(*k, F.explode(F.array(*entries)).alias("_f")).select(*k, "_f.*")
              .filter(F.col("_key").isNotNull()))
    top = ranks.top_n_with_ties(tagged, [*k, "record"], "_key", n, ascending=True)
    return top.select(*k, F.col("rank").cast("int").alias("rank"), "date", "metric_value", "record")


def records_page(records: DataFrame, record: str, keys: Sequence[str] = ("station",),
                 decimals: int = 2, as_of_year=None, observed: DataFrame | None = None) -> DataFrame:
    """One record family as a page: rank, date label, rounded value and a
    flag for records set in the last three years: relative to ``as_of_year``,
    or else to each station's latest year in the table ``observed`` (with a
    ``date`` column) that the records were made from — never the clock."""
    k = list(keys)
    r = records.filter(F.col("record") == record)
    if as_of_year is None:
        if observed is None:
            raise ValueError("records_page needs as_of_year, or the observed table to take each station's latest year from")
        sc = reshape.per_key_scalars(observed, k, _asof=F.max(F.year("date")))
        r = reshape.attach_scalars(r, sc, k)
    else:
        r = r.withColumn("_asof", F.lit(int(as_of_year)))
    recent = None
    for i in range(RECENT_YEARS):
        c = F.col("date").contains((F.col("_asof") - i).cast("string"))
        recent = c if recent is None else (recent | c)
    return r.select(*k, "rank", "date", F.bround("metric_value", decimals).alias("metric_value"),
                    recent.alias("recent"))
