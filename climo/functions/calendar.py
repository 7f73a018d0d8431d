"""Calendar attributes as Column expressions (no Python UDFs).

All functions take and return ``Column`` objects (strings are accepted as
column names) so Catalyst folds them into the surrounding projection and
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must match the reference's conventions) ----------------
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Day-index shift of each calendar: calendar year starts Jan 1, water year
# starts Oct 1 (92 days before Jan 1), snow season starts Aug 1 (153 days).
YEAR_TYPE_SHIFT = {"calendar_year": 0, "water_year": 92, "snow_season": 153}
YEAR_TYPES = ["calendar_year", "water_year", "snow_season"]
# Meteorological seasons by month number.
SEASON_OF_MONTH = {12: "winter", 1: "winter", 2: "winter",
                   3: "spring", 4: "spring", 5: "spring",
                   6: "summer", 7: "summer", 8: "summer",
                   9: "fall", 10: "fall", 11: "fall"}
LEAP_DAY_INDEX = 59.5
YEAR_LABEL = "Year"          # pseudo-month holding yearly totals
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_leap_year(year) -> Column:
    y = _c(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def doy_index(date, year_type: str = "calendar_year") -> Column:
    """Leap-aware day index (F1).

    Feb 29 maps to 59.5 and later days of a leap year move back by one, so
    every year has indexes 1..365 (+59.5).  The result is shifted so that
    day 1 is the first day of the chosen calendar (calendar year, water year
    starting Oct 1, snow season starting Aug 1).
    """
    d = _c(date)
    doy = F.dayofyear(d).cast("double")
    leap = is_leap_year(F.year(d))
    v = (F.when(leap & (doy > 60), doy - 1)
         .when(leap & (doy == 60), F.lit(LEAP_DAY_INDEX))
         .otherwise(doy))
    shift = YEAR_TYPE_SHIFT[year_type]
    if shift == 0:
        return v
    return F.pmod(v + F.lit(float(shift - 1)), F.lit(365.0)) + 1


def doy_index_for(date, year_type_col) -> Column:
    """``doy_index`` where the calendar is itself a column value."""
    yt = _c(year_type_col)
    expr = None
    for name in YEAR_TYPES:
        branch = doy_index(date, name)
        expr = F.when(yt == name, branch) if expr is None else expr.when(yt == name, branch)
    return expr


def doy_label(doy) -> Column:
    """Calendar label ``'Mon DD'`` of a day index on a non-leap year."""
    d = _c(doy)
    base = F.date_add(F.lit("2025-01-01").cast("date"), F.floor(d).cast("int") - 1)
    return F.when(d == LEAP_DAY_INDEX, F.lit("Feb 29")).otherwise(F.date_format(base, "MMM dd"))


def season_doy_to_calendar(doy) -> Column:
    """Snow-season index back to a calendar index (F4): ``int((d-154) mod 365 + 1)``."""
    return F.floor(F.pmod(_c(doy) - 154, F.lit(365.0)) + 1).cast("int")


def season_start(date, start_month: int = 8) -> Column:
    """First calendar year of the season a date falls in (snow season Aug-Jul)."""
    d = _c(date)
    return (F.year(d) - F.when(F.month(d) >= start_month, 0).otherwise(1)).cast("int")


def season_label(start) -> Column:
    """``'YYYY-YYYY'`` label from the season's first year."""
    s = _c(start).cast("int")
    return F.concat(s.cast("string"), F.lit("-"), (s + 1).cast("string"))


def season_label_start(label) -> Column:
    """First year of a ``'YYYY-YYYY'`` season label."""
    return F.split(_c(label), "-").getItem(0).cast("int")


def offset_season(label, k: int) -> Column:
    """Shift a ``'YYYY-YYYY'`` label by ``k`` years."""
    parts = F.split(_c(label), "-")
    return F.concat((parts.getItem(0).cast("int") + k).cast("string"), F.lit("-"),
                    (parts.getItem(1).cast("int") + k).cast("string"))


def water_year(date, start_month: int = 10) -> Column:
    d = _c(date)
    return (F.year(d) + F.when(F.month(d) >= start_month, 1).otherwise(0)).cast("int")


def normal_window(year, n_years: int = 30, last_complete_decade: bool = True):
    """(start, end) years of a normals window.

    Works on Python ints and on Columns.  Decade mode ends at the last year
    divisible by 10 (``floor(y/10)*10``); otherwise at ``y-1``.
    """
    if isinstance(year, int):
        end = (year // 10) * 10 if last_complete_decade else year - 1
        return end - n_years + 1, end
    y = _c(year)
    end = (F.floor(y / 10) * 10).cast("int") if last_complete_decade else (y - 1).cast("int")
    return (end - n_years + 1).cast("int"), end


def month_label(date) -> Column:
    return F.date_format(_c(date), "MMM")


def month_num_of_label(label) -> Column:
    """1..12 for 'Jan'..'Dec', 13 for the 'Year' pseudo-month."""
    m = F.create_map(*[x for i, lab in enumerate(MONTH_LABELS + [YEAR_LABEL])
                       for x in (F.lit(lab), F.lit(i + 1))])
    return m[_c(label)]


def season_of_month(month_num) -> Column:
    """Meteorological season of a month number."""
    m = _c(month_num)
    expr = None
    for season in ("winter", "spring", "summer", "fall"):
        months = [k for k, v in SEASON_OF_MONTH.items() if v == season]
        expr = F.when(m.isin(*months), season) if expr is None else expr.when(m.isin(*months), season)
    return expr


def doy_from_label(label, leap_year: int = 2024, year_type: str = "calendar_year") -> Column:
    """``'Mon DD'`` label → day index through a leap year."""
    d = F.to_date(F.concat(_c(label), F.lit(f" {leap_year}")), "MMM dd yyyy")
    return doy_index(d, year_type)


def decimal_hour(ts) -> Column:
    """Hour of day with minutes as a fraction."""
    t = _c(ts)
    return F.hour(t) + F.minute(t) / 60.0


def iso_to_decimal_hour(iso_str) -> Column:
    """``'yyyy-MM-ddTHH:mm'`` string → decimal hour."""
    hm = F.split(F.split(_c(iso_str), "T").getItem(1), ":")
    return hm.getItem(0).cast("int") + hm.getItem(1).cast("int") / 60.0


def days_since(ts, origin) -> Column:
    """Fractional days between ``origin`` and ``ts``.

    Computed on zone-free ``TIMESTAMP_NTZ`` values, so the result does not
    depend on the session time zone (no 23/25-hour days at DST changes)."""
    t = _c(ts).cast("timestamp_ntz")
    o = _c(origin).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", o, t) / 86_400_000_000.0


def months_since(date, origin) -> Column:
    d, o = _c(date), _c(origin)
    return ((F.year(d) - F.year(o)) * 12 + F.month(d) - F.month(o)).cast("int")


def fraction_of_year(date) -> Column:
    """Day of year divided by the length of that year."""
    d = _c(date)
    return F.dayofyear(d) / F.when(is_leap_year(F.year(d)), 366.0).otherwise(365.0)


def calendar_columns(date_col: str = "date", season_start_month: int = 8,
                     water_start_month: int = 10) -> dict:
    """The standard calendar attributes of a daily row."""
    d = F.col(date_col)
    s = season_start(d, season_start_month)
    return {
        "year": F.year(d),
        "month": month_label(d),
        "month_num": F.month(d),
        "day_of_month": F.dayofmonth(d),
        "water_year": water_year(d, water_start_month),
        "season_start": s,
        "snow_season": season_label(s),
        "day_of_year": doy_index(d, "calendar_year"),
    }
