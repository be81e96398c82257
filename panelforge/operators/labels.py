"""Occurrence and severity labels of panel rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import label_burn_ratio
from ..functions.labels import (
    LOW_UPPER,
    MAX_DNBR,
    MIN_DNBR,
    MODERATE_UPPER,
    any_label_set,
    clip,
    flag_from_count,
    severity_class,
)
from ..functions.missing import safe_float
from .composites import HORIZONS
from .keys import future_window


def occurrence_labels(df: DataFrame, *, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """``y_occ_{h}d`` from future counts (absent counts give 0) and the label window."""
    start, end = future_window(F.col("reference_date"), max(horizons))

    def count(h: int) -> Column:
        name = f"viirs_future_fire_count_{h}d"
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    return df.withColumns(
        {f"y_occ_{h}d": flag_from_count(count(h)) for h in horizons}
        | {"label_window_start": start, "label_window_end": end}
    )


def resolve_dnbr(df: DataFrame) -> Column:
    """Given difference, else the difference of two burn ratios, else from four bands."""

    def number(name: str) -> Column:
        return safe_float(F.col(name)) if name in df.columns else F.lit(None).cast("double")

    pair = number("prefire_nbr") - number("postfire_nbr")
    bands = label_burn_ratio(number("prefire_nir_mean"), number("prefire_swir2_mean")) - label_burn_ratio(
        number("postfire_nir_mean"), number("postfire_swir2_mean")
    )
    return F.coalesce(number("dnbr"), pair, bands)


def severity_labels(
    df: DataFrame,
    *,
    low_upper: float = LOW_UPPER,
    moderate_upper: float = MODERATE_UPPER,
    min_dnbr: float = MIN_DNBR,
    max_dnbr: float = MAX_DNBR,
) -> DataFrame:
    """Severity targets of fire rows; class and regression use the same clipped value."""
    fire = any_label_set([F.col(f"y_occ_{h}d") for h in HORIZONS if f"y_occ_{h}d" in df.columns])
    value = F.when(fire, clip(resolve_dnbr(df), min_dnbr, max_dnbr))
    return df.withColumn("y_sev_reg", value).withColumns(
        {
            "y_sev_cls": severity_class(F.col("y_sev_reg"), low_upper, moderate_upper),
            "y_sev_available": F.col("y_sev_reg").isNotNull().cast("int"),
        }
    )
