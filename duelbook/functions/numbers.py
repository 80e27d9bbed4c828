"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num/den as double, 0 where the denominator is 0 or missing."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def half_even(col: Column, places: int = 2) -> Column:
    return F.bround(col, places)


def elo_expected(own: Column, other: Column) -> Column:
    """Chance that the first rating beats the second, on the 400-point logistic scale."""
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (other - own) / F.lit(400.0)))
