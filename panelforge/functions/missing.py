"""Missing-value rules. NULL is the only missing marker past a scan."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column (``NaN > 0`` is true in Spark)."""
    return df.select(
        *[
            nan_to_null(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def safe_float(value: Column) -> Column:
    """Double, or NULL where the value is missing, NaN or not a number."""
    return nan_to_null(value.try_cast("double"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL on a zero denominator."""
    return F.try_divide(numerator, denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 on a zero denominator; NULL inputs stay NULL."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.try_divide(numerator, denominator))


def finite_or_null(value: Column) -> Column:
    """NULL for NaN and both infinities; used by the JSON sink."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
