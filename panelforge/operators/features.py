"""Features of panel rows and of their history."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import enhanced_vegetation, normalized_difference
from .ordered import exact_quantiles

# Feature namespaces, names kept out of models, rolling inputs and windows.
FEATURE_PREFIXES = ("optical_", "weather_", "terrain_", "landcover_", "human_", "temporal_")
NOT_FEATURES = {"centroid_lat", "centroid_lon", "temporal_row_index", "temporal_recent_count_30d_placeholder"}
ROLLING_COLUMNS = ("optical_ndvi", "optical_ndmi", "optical_nbr_prefire")
ROLLING_WINDOWS = (3, 7)


def feature_columns(df: DataFrame) -> list[str]:
    """Model features by name space; bounds and centroids stay out so models cannot learn places."""
    return [c for c in df.columns if c.startswith(FEATURE_PREFIXES) and c not in NOT_FEATURES]


def ablate_family(df: DataFrame, families: Sequence[str] = FEATURE_PREFIXES) -> dict[str, DataFrame]:
    """One frame per feature family, without that family's columns."""
    return {f.rstrip("_"): df.drop(*[c for c in df.columns if c.startswith(f)]) for f in families}


def band_column(df: DataFrame, band: str) -> str | None:
    return next((c for c in df.columns if c.startswith(f"optical_{band}_mean_l")), None)


def spectral_indices(df: DataFrame) -> DataFrame:
    """Add the indices whose bands exist; absent bands add no column."""
    b2, b4, b8, b11, b12 = (F.col(n) if (n := band_column(df, b)) else None for b in ("b2", "b4", "b8", "b11", "b12"))
    added: dict[str, Column] = {}
    if b8 is not None and b4 is not None:
        added["optical_ndvi"] = normalized_difference(b8, b4)
    if b8 is not None and b11 is not None:
        added["optical_ndmi"] = normalized_difference(b8, b11)
    if b8 is not None and b4 is not None and b2 is not None:
        added["optical_evi"] = enhanced_vegetation(b8, b4, b2)
    if b8 is not None and b12 is not None:
        added["optical_nbr_prefire"] = normalized_difference(b8, b12)
    if "optical_s2_observation_count" in df.columns:
        seen = F.coalesce(F.col("optical_s2_observation_count") > 0, F.lit(False))
        added["optical_s2_signal_available"] = seen.cast("int")
    return df.withColumns(added) if added else df


def rolling_stats(
    df: DataFrame,
    columns: Sequence[str] = ROLLING_COLUMNS,
    windows: Sequence[int] = ROLLING_WINDOWS,
) -> DataFrame:
    """Mean and sample deviation over each patch's last rows, the current one included.

    Frames only look back, so rolling before a split leaks nothing. All frames share
    one shuffle and sort on the patch; unique daily keys bound a patch to its days.
    """
    present = [c for c in columns if c in df.columns]
    by_date = Window.partitionBy("patch_id").orderBy("reference_date")
    added = {}
    for c in present:
        for n in windows:
            last = by_date.rowsBetween(-(n - 1), 0)
            added[f"temporal_{c}_rmean_{n}"] = F.avg(c).over(last)
            added[f"temporal_{c}_rstd_{n}"] = F.coalesce(F.stddev_samp(c).over(last), F.lit(0.0))
    return df.select("*", *[v.alias(k) for k, v in added.items()])


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians, one number per column; all-missing columns give 0.0."""
    found = {r["feature"]: r["quantile"] for r in exact_quantiles(df, columns, [0.5]).collect()}
    return {c: found.get(c, 0.0) for c in columns}


def build_sequences(
    df: DataFrame,
    columns: Sequence[str],
    *,
    seq_len: int = 16,
    occ_col: str = "y_occ_30d",
    sev_col: str = "y_sev_reg",
    sev_mask_col: str = "y_sev_available",
    medians: Mapping[str, float] | None = None,
    split_col: str | None = None,
) -> DataFrame:
    """History of each row: ``x`` (seq_len x features), ``pad_mask``, targets.

    Missing features take the training medians before collecting (``collect_list``
    skips NULL). Short histories are padded with zeros in front, marked true. With
    ``split_col`` histories do not reach into another split.
    """
    if medians is None:
        medians = column_medians(df, columns)
    step = F.array(
        *[F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c, 0.0)))).cast("float") for c in columns]
    )
    group = [split_col, "patch_id"] if split_col else ["patch_id"]
    last = Window.partitionBy(*group).orderBy("reference_date").rowsBetween(-(seq_len - 1), 0)
    seen = df.select(
        *group,
        "reference_date",
        F.collect_list(step).over(last).alias("_seen"),
        F.col(occ_col).cast("float").alias("y_occ"),
        F.coalesce(F.col(sev_col).cast("float"), F.lit(0.0).cast("float")).alias("y_sev"),
        F.col(sev_mask_col).cast("float").alias("y_sev_available"),
    )
    missing = F.lit(seq_len) - F.size("_seen")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), len(columns))
    return seen.select(
        *group,
        "reference_date",
        F.concat(F.array_repeat(zeros, missing), F.col("_seen")).alias("x"),
        F.transform(F.sequence(F.lit(0), F.lit(seq_len - 1)), lambda i: i < missing).alias("pad_mask"),
        "y_occ",
        "y_sev",
        "y_sev_available",
    )
