"""Inverse of the standard normal distribution in column arithmetic."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of the published rational approximation by
# P. J. Acklam (relative error below 1.15e-9), centre and tail.
CENTRE_NUM = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
              1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_DEN = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
              6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_NUM = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_DEN = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00, 1.0]
TAIL_FROM = 0.02425


def _polynomial(coefficients: list[float], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def with_inverse_normal(df: DataFrame, columns: Sequence[str], margin: float = 1e-7) -> DataFrame:
    """Replace probabilities, clipped ``margin`` away from 0 and 1, by normal quantiles.

    In steps over plain columns: one nested expression would repeat its inputs in
    every polynomial term and outgrow the generated-code limit.
    """

    def centred(q: Column) -> Column:
        return F.abs(q - 0.5) <= 0.5 - TAIL_FROM

    q = {f"_q_{c}": F.least(F.greatest(F.col(c), F.lit(margin)), F.lit(1.0 - margin)) for c in columns}
    out = df.withColumns(q)
    terms = {}
    for c in columns:
        p = F.col(f"_q_{c}")
        tail = F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
        terms[f"_z_{c}"] = F.when(centred(p), (p - 0.5) * (p - 0.5)).otherwise(tail)
    out = out.withColumns(terms)
    made = {}
    for c in columns:
        p, z = F.col(f"_q_{c}"), F.col(f"_z_{c}")
        centre = (p - 0.5) * _polynomial(CENTRE_NUM, z) / _polynomial(CENTRE_DEN, z)
        tail = _polynomial(TAIL_NUM, z) / _polynomial(TAIL_DEN, z)
        value = F.when(centred(p), centre).when(p < 0.5, tail).otherwise(-tail)
        made[c] = F.when(F.col(c).isNotNull(), value)
    return out.withColumns(made).drop(*q, *terms)
