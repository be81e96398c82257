"""Panel keys: grid patches, reference dates, the patch x date spine, windows."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["patch_id", "reference_date"]
PATCH_COLUMNS = ["patch_id", "min_lon", "min_lat", "max_lon", "max_lat"]
KM_PER_DEGREE = 111.0

# The preset area (min lon, min lat, max lon, max lat) and its id prefix.
PRESET_BOUNDS = (94.0, -11.0, 141.0, 6.5)
PRESET_PREFIX = "indo"

GRID_ID = r"^(.+)_(\d+)_(\d+)$"


def grid_shape(bounds: tuple[float, float, float, float], grid_km: float) -> tuple[int, int, float]:
    """(rows, columns, step in degrees) of the half-open tiling of a box."""
    min_lon, min_lat, max_lon, max_lat = bounds
    step = grid_km / KM_PER_DEGREE
    return math.ceil((max_lat - min_lat) / step), math.ceil((max_lon - min_lon) / step), step


def patch_grid(
    spark: SparkSession,
    bounds: tuple[float, float, float, float] = PRESET_BOUNDS,
    *,
    grid_km: float = 5,
    prefix: str = PRESET_PREFIX,
) -> DataFrame:
    """Rectangular patches of ``grid_km`` over a lon/lat box; edge cells are clipped.

    One ``range`` numbers all cells, so cells are made where they are used.
    """
    min_lon, min_lat, max_lon, max_lat = bounds
    rows, cols, step = grid_shape(bounds, grid_km)
    row = F.floor(F.col("id") / cols).cast("int")
    col = (F.col("id") % cols).cast("int")
    cells = spark.range(rows * cols).select(row.alias("row"), col.alias("col"))
    return (
        cells.withColumn("min_lon", F.lit(min_lon) + F.col("col") * F.lit(step))
        .withColumn("min_lat", F.lit(min_lat) + F.col("row") * F.lit(step))
        .withColumn("max_lon", F.least(F.col("min_lon") + F.lit(step), F.lit(max_lon)))
        .withColumn("max_lat", F.least(F.col("min_lat") + F.lit(step), F.lit(max_lat)))
        .select(
            F.concat_ws("_", F.lit(prefix), "row", "col").alias("patch_id"),
            "row",
            "col",
            "min_lon",
            "min_lat",
            "max_lon",
            "max_lat",
            ((F.col("min_lon") + F.col("max_lon")) / 2).alias("centroid_lon"),
            ((F.col("min_lat") + F.col("max_lat")) / 2).alias("centroid_lat"),
        )
    )


def step_days(frequency: str | int) -> int:
    """Days of a ``7D`` / ``2W`` style step."""
    if isinstance(frequency, int):
        return frequency
    count, unit = frequency[:-1] or "1", frequency[-1].upper()
    return int(count) * {"D": 1, "W": 7}[unit]


def date_steps(start: str, end: str, frequency: str | int = "7D") -> Column:
    """Array of reference dates, both ends included."""
    return F.expr(f"sequence(DATE '{start}', DATE '{end}', INTERVAL '{step_days(frequency)}' DAY)")


def reference_dates(spark: SparkSession, start: str, end: str, frequency: str | int = "7D") -> DataFrame:
    return spark.range(1).select(F.explode(date_steps(start, end, frequency)).alias("reference_date"))


def lookback_window(reference: Column, lookback_days: int) -> tuple[Column, Column]:
    """[ref - L, ref], both included."""
    return F.date_sub(reference, lookback_days), reference


def future_window(reference: Column, horizon_days: int) -> tuple[Column, Column]:
    """[ref + 1, ref + H], both included."""
    return F.date_add(reference, 1), F.date_add(reference, horizon_days)


def panel_spine(patches: DataFrame, start: str, end: str, frequency: str | int = "7D") -> DataFrame:
    """One row per patch and reference date, made by exploding dates in place: no join, no shuffle."""
    extra = [c for c in patches.columns if c not in PATCH_COLUMNS]
    return patches.select(
        "patch_id",
        F.explode(date_steps(start, end, frequency)).alias("reference_date"),
        *[F.col(c).alias(f"static_{c}") for c in PATCH_COLUMNS[1:]],
        ((F.col("min_lon") + F.col("max_lon")) / 2.0).alias("centroid_lon"),
        ((F.col("min_lat") + F.col("max_lat")) / 2.0).alias("centroid_lat"),
        *extra,
    )


def finish_keys(panel: DataFrame) -> DataFrame:
    """Add ``reference_year``; window and leakage columns become timestamps."""
    out = panel.withColumn("reference_year", F.year("reference_date"))
    for name in ("label_window_start", "label_window_end", "feature_max_timestamp"):
        if name in out.columns:
            out = out.withColumn(name, F.to_timestamp(name))
    return out


def grid_coordinates(df: DataFrame, *, patch_col: str = "patch_id", strict: bool = False) -> DataFrame:
    """Add ``grid_prefix, grid_row, grid_col``; ids of another form give NULLs.

    ``strict`` raises inside the plan, at the first bad row, and costs no extra pass.
    """
    pid = F.col(patch_col)
    if strict:
        pid = F.when(pid.rlike(GRID_ID), pid).otherwise(
            F.raise_error(
                F.concat(
                    F.lit("patch ids must look like <prefix>_<row>_<col>; example: "),
                    F.coalesce(F.col(patch_col), F.lit("NULL")),
                )
            )
        )
    prefix = F.regexp_extract(pid, GRID_ID, 1)
    return df.select(
        "*",
        F.when(prefix != "", prefix).alias("grid_prefix"),
        F.regexp_extract(pid, GRID_ID, 2).try_cast("int").alias("grid_row"),
        F.regexp_extract(pid, GRID_ID, 3).try_cast("int").alias("grid_col"),
    )


def bad_grid_ids(df: DataFrame, *, patch_col: str = "patch_id", limit: int = 3) -> DataFrame:
    """Up to ``limit`` examples of ids without grid form, for error messages."""
    pid = F.col(patch_col)
    return df.filter(pid.isNull() | ~pid.rlike(GRID_ID)).select(patch_col).limit(limit)
