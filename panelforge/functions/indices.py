"""Spectral index expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ratio_or_zero, safe_ratio


def normalized_difference(a: Column, b: Column) -> Column:
    """(a-b)/(a+b); NULL when the sum is zero."""
    return safe_ratio(a - b, a + b)


def enhanced_vegetation(nir: Column, red: Column, blue: Column) -> Column:
    return F.lit(2.5) * safe_ratio(nir - red, nir + 6.0 * red - 7.5 * blue + 1.0)


def label_burn_ratio(nir: Column, swir2: Column) -> Column:
    """Burn ratio on the label path: a zero denominator counts as 0.0, not missing."""
    return ratio_or_zero(nir - swir2, nir + swir2)
