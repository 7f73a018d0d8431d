"""Derived measurements as Column expressions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
SWE_RATIO = 8.0            # snow-to-liquid ratio for mixed days
ALL_RAIN_ABOVE = 37.0      # tmin above this: all precipitation is rain
ALL_SNOW_BELOW = 29.0      # tmax below this: no rain
WIND_SPEED_EDGES = [0, 10, 15, 20, 30, 40]
WIND_SPEED_LABELS = ["0-10", "10-15", "15-20", "20-30", "30-40", "40+"]
COMPASS_SECTORS = 16
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    """NaN → NULL so aggregates skip missing values like the reference (Q1)."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_numeric(x) -> Column:
    """Coerce strings to double, invalid → NULL."""
    return nan_to_null(_c(x).try_cast("double"))


def precip_day(precip) -> Column:
    """1 if precipitation > 0 else 0; NULL precip counts as 0 (F8)."""
    return F.when(_c(precip) > 0, 1).otherwise(0)


def rain(precip, snow, tmin, tmax, ratio: float = SWE_RATIO,
         all_rain_above: float = ALL_RAIN_ABOVE, all_snow_below: float = ALL_SNOW_BELOW) -> Column:
    """Liquid part of precipitation.

    tmin > 37 → all rain; tmax < 29 → none; otherwise ``max(precip - snow/8, 0)``.
    A NULL in precip or snow gives NULL on the mixed branch (``greatest`` alone
    would turn it into 0, see Q2).
    """
    p, s = _c(precip), _c(snow)
    mixed = p - s / ratio
    mixed = F.when(mixed.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(mixed, F.lit(0.0)))
    return (F.when(_c(tmin) > all_rain_above, p)
            .when(_c(tmax) < all_snow_below, F.lit(0.0))
            .otherwise(mixed))


def snow_water_equiv(precip, rain_col) -> Column:
    return _c(precip) - _c(rain_col)


def step_bin(x, edges: Sequence[float], labels: Sequence[str], max_label: str,
             null_label: str | None = None) -> Column:
    """First label whose edge satisfies ``x <= edge``; above all edges → max_label.

    NULL input gives ``null_label`` (the reference would put NaN in the top
    bin; we keep missing values separate, documented deviation Q14).
    """
    v = _c(x)
    expr = F.when(v.isNull(), F.lit(null_label))
    for e, lab in zip(edges, labels):
        expr = expr.when(v <= e, F.lit(lab))
    return expr.otherwise(F.lit(max_label))


def cut(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(lo, hi]``; values at or below the lowest edge → NULL."""
    v = _c(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (v > lo) & (v <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def wind_speed_bin(speed) -> Column:
    """Wind speed category: right-closed bins; the last one has no upper edge (the reference's is the data maximum)."""
    v = _c(speed)
    edges = WIND_SPEED_EDGES
    expr = None
    for i, lab in enumerate(WIND_SPEED_LABELS):
        lo = F.lit(float(edges[i]))
        cond = (v > lo) & (v <= float(edges[i + 1])) if i + 1 < len(edges) else (v > lo) & ~F.isnan(v)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def compass_sector(direction, sectors: int = COMPASS_SECTORS) -> Column:
    """Direction rounded (half-even) to the nearest of ``sectors`` headings."""
    w = 360.0 / sectors
    return F.pmod(F.bround(_c(direction) / w) * w, F.lit(360.0))


def diurnal_range(tmax, tmin) -> Column:
    return _c(tmax) - _c(tmin)


def departure(x, normal) -> Column:
    return _c(x) - _c(normal)


def anomaly_pct(x, normal) -> Column:
    """``100 * (x / normal - 1)``; NULL when the normal is 0."""
    n = _c(normal)
    return F.when(n != 0, 100.0 * (_c(x) / n - 1.0))


def round_half_even(x, dp: int = 1) -> Column:
    """numpy-style rounding."""
    return F.bround(_c(x), dp)
