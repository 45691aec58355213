"""Rounding as Python's ``round`` does it: the exact binary value to the nearest
decimal, halves to the even one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2 * 10**places as a sum of powers of two, by which a double is multiplied without error.
_POWERS = {1: (16.0, 4.0), 2: (128.0, 64.0, 8.0)}


def to_int(c: Column) -> Column:
    """Whole numbers; a half is exact in binary, so ``bround`` is right."""
    return F.bround(c, 0).cast("int")


def _two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """The rounded sum of two doubles and its error, which is exact."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def to_places(c: Column, places: int) -> Column:
    """``c`` at one or two decimals. ``bround`` goes by the shortest decimal text of a
    double, whose last 5 may stand for a value that lies beside the half."""
    c = c.cast("double")
    first, *rest = (c * F.lit(p) for p in _POWERS[places])
    twice, error = first, F.lit(0.0)
    for term in rest:
        twice, e = _two_sum(twice, term)
        error = error + e
    low = F.floor(c * F.lit(10.0**places)).cast("double")
    side = (twice - (2 * low + 1)) + error  # of the half between low and low + 1
    up = (side > 0) | ((side == 0) & (F.pmod(low, F.lit(2.0)) == 1))
    return F.when(c.isNotNull(), (low + F.when(up, 1.0).otherwise(0.0)) / F.lit(10.0**places))
