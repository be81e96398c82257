"""Integrity checks and data summaries.

Each check has a form that returns the offending rows and an ``enforce_`` form
that raises with their number (one aggregate, one row to the driver).
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keys import KEYS

# The least a canonical panel must carry.
LABEL_COLUMNS = [
    "y_occ_7d",
    "y_occ_30d",
    "y_occ_60d",
    "y_sev_reg",
    "y_sev_cls",
    "y_sev_available",
    "label_window_start",
    "label_window_end",
]
REQUIRED_COLUMNS = KEYS + LABEL_COLUMNS + ["feature_max_timestamp"]


class ContractError(ValueError):
    """A panel breaks its contract."""


def ensure_required_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"panel lacks required columns: {missing}")


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys held by more than one row, with the rows beyond the first."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("extra_rows")).filter("extra_rows > 0")


def enforce_unique(df: DataFrame, keys: Sequence[str] = KEYS) -> None:
    extra = duplicate_keys(df, keys).agg(F.coalesce(F.sum("extra_rows"), F.lit(0)).alias("n")).first()["n"]
    if extra:
        raise ContractError(f"{extra} duplicate rows on {list(keys)}")


def leakage_violations(df: DataFrame) -> DataFrame:
    """Rows whose features saw data after the reference date."""
    return df.filter(F.col("feature_max_timestamp").cast("timestamp") > F.col("reference_date").cast("timestamp"))


def severity_mask_violations(df: DataFrame) -> DataFrame:
    """Rows marked severity-unavailable that still carry a severity label."""
    if "y_sev_available" not in df.columns:
        raise ContractError("y_sev_available is missing")
    labelled = F.col("y_sev_reg").isNotNull() | F.col("y_sev_cls").isNotNull()
    return df.filter((F.col("y_sev_available") == 0) & labelled)


def label_order_violations(df: DataFrame) -> DataFrame:
    """Rows whose label window does not start after the reference date."""
    return df.filter(F.col("label_window_start").cast("timestamp") <= F.col("reference_date").cast("timestamp"))


def _enforce(bad: DataFrame, what: str) -> None:
    n = bad.count()
    if n:
        raise ContractError(f"{n} rows {what}")


def enforce_no_leakage(df: DataFrame) -> None:
    _enforce(leakage_violations(df), "have features from after the reference date")


def enforce_severity_mask(df: DataFrame) -> None:
    _enforce(severity_mask_violations(df), "carry severity labels though severity is unavailable")


def enforce_label_order(df: DataFrame) -> None:
    _enforce(label_order_violations(df), "have a label window that starts too early")


def _is_missing(df: DataFrame, name: str):
    col = F.col(f"`{name}`")
    is_float = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return (col.isNull() | F.isnan(col)) if is_float else col.isNull()


def _long_rates(one_row: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_rate")) for c in columns])
    return one_row.select(F.inline(pairs))


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of missing values per column, from one aggregate."""
    columns = list(columns or df.columns)
    rates = df.agg(*[F.avg(_is_missing(df, c).cast("double")).alias(c) for c in columns])
    return _long_rates(rates, columns)


def top_missing(df: DataFrame, n: int = 20) -> DataFrame:
    """The n columns with the most missing values; ties by name."""
    return missing_rates(df).orderBy(F.col("missing_rate").desc(), "column").limit(n)


def label_missingness(df: DataFrame) -> DataFrame:
    return missing_rates(df, [c for c in LABEL_COLUMNS[:6] if c in df.columns])


def dataset_summary(df: DataFrame, target: str = "y_occ_30d") -> DataFrame:
    """One row: rows, patches, date range, positive rate. Counting per patch first
    replaces a distinct count by two aggregates that combine before the shuffle."""
    has_target = target in df.columns
    per_patch = df.groupBy("patch_id").agg(
        F.count("*").alias("n"),
        F.min("reference_date").alias("first"),
        F.max("reference_date").alias("last"),
        *([F.sum(target).alias("pos"), F.count(target).alias("known")] if has_target else []),
    )
    rate = F.try_divide(F.sum("pos"), F.sum("known")) if has_target else F.lit(None).cast("double")
    return per_patch.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count("patch_id").alias("unique_patches"),
        F.min("first").cast("date").alias("reference_date_min"),
        F.max("last").cast("date").alias("reference_date_max"),
        rate.alias(f"positive_rate_{target}"),
    )


def class_distribution(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, target).count()
