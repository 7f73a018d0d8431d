"""Student's t distribution as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest degrees of freedom for which the finite series is summed; beyond it Fisher's expansion is exact to 1e-12.
SERIES_DOF = 2000
#: p-values are rounded to so many places: 1 - A has no digits beyond them.
PLACES = 12


def _series(theta: Column, dof: Column) -> Column:
    """P(|T| <= t) for whole ``dof``, theta = atan(t / sqrt(dof)), by the finite trigonometric series.

    Odd: 2/pi (theta + sin cos (1 + 2/3 cos^2 + 2*4/(3*5) cos^4 + ...)), (dof - 1) / 2 terms.
    Even: sin (1 + 1/2 cos^2 + 1*3/(2*4) cos^4 + ...), dof / 2 terms.
    """
    odd = F.pmod(dof, F.lit(2)) == 1
    square = F.pow(F.cos(theta), 2)
    n_terms = F.floor(dof / 2)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        ratio = F.when(odd, 2.0 * i / (2.0 * i + 1.0)).otherwise((2.0 * i - 1.0) / (2.0 * i))
        return F.struct((acc["term"] * ratio * square).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    places = F.when(n_terms >= 1, F.sequence(F.lit(1).cast("long"), n_terms)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(places, zero, add)["total"]
    return F.when(odd, 2.0 / math.pi * (theta + F.sin(theta) * F.cos(theta) * total)).otherwise(F.sin(theta) * total)


def _erfc(x: Column) -> Column:
    """erfc of x >= 0: 1 - 2/sqrt(pi) exp(-x^2) sum of 2^n x^(2n+1) / (2n+1)!!, all terms positive."""
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        return F.struct((acc["term"] * 2.0 * x * x / (2.0 * i + 1.0)).alias("term"), (acc["total"] + acc["term"]).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(160)), zero, add)["total"]
    return F.when(x > 6, 0.0).otherwise(1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-x * x) * x * total)


def _expansion(t: Column, dof: Column) -> Column:
    """Two-sided p by Fisher's expansion around the normal distribution, for large ``dof`` (t >= 0)."""
    t2 = t * t
    first = t * (t2 + 1) / 4
    second = t * (((3 * t2 - 7) * t2 - 5) * t2 - 3) / 96
    third = t * (((((t2 - 11) * t2 + 14) * t2 + 6) * t2 - 3) * t2 - 15) / 384
    density = F.exp(-t2 / 2) / math.sqrt(2 * math.pi)
    return _erfc(t / math.sqrt(2.0)) + 2.0 * density * (first / dof + second / (dof * dof) + third / (dof * dof * dof))


def two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of a t statistic with whole degrees of freedom, to ``PLACES`` places; NULL for NULL or ``dof`` < 1."""
    size, whole = F.abs(t.cast("double")), dof.cast("long")
    small = F.least(whole, F.lit(SERIES_DOF))
    theta = F.atan2(size, F.sqrt(small.cast("double")))
    p = F.when(whole <= SERIES_DOF, 1.0 - _series(theta, small)).otherwise(_expansion(size, whole.cast("double")))
    return F.when((whole >= 1) & size.isNotNull(), F.round(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)), PLACES))
