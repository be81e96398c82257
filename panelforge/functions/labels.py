"""Label expressions."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import safe_float

# Class limits for the burn-ratio difference and its clip range.
LOW_UPPER = 0.27
MODERATE_UPPER = 0.44
MIN_DNBR = -0.1
MAX_DNBR = 1.3


def flag_from_count(value: Column) -> Column:
    """1 when the count is positive; missing or non-numeric counts give 0."""
    return F.coalesce(safe_float(value) > 0, F.lit(False)).cast("int")


def any_label_set(labels: Sequence[Column]) -> Column:
    """True when one of the labels equals 1; missing labels are ignored."""
    hit = F.lit(False)
    for label in labels:
        hit = hit | F.coalesce(label.try_cast("int") == 1, F.lit(False))
    return hit


def severity_class(dnbr: Column, low_upper: float = LOW_UPPER, moderate_upper: float = MODERATE_UPPER) -> Column:
    return (
        F.when(dnbr.isNull(), None)
        .when(dnbr <= low_upper, 0)
        .when(dnbr <= moderate_upper, 1)
        .otherwise(2)
        .cast("int")
    )


def clip(value: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Clip to [low, high]; NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    out = value
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    return F.when(value.isNotNull(), out)
