"""Equi joins onto the spine, and points to patches."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import KEYS, KM_PER_DEGREE


def static_join(spine: DataFrame, lookup: DataFrame, on: str | Sequence[str] = "patch_id") -> DataFrame:
    """Left join of per-patch values. No broadcast hint: the lookup grows with the
    patches, so Spark compares its size with the broadcast threshold and shuffles beyond it."""
    return spine.join(lookup, on, "left")


def merge_sources(spine: DataFrame, summaries: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Left-join source summaries one by one; a later source replaces columns of the same name."""
    out = spine
    for summary in summaries:
        on = [k for k in keys if k in summary.columns]
        clash = [c for c in summary.columns if c in out.columns and c not in on]
        out = out.drop(*clash).join(summary, on, "left")
    return out


def assign_patch(
    points: DataFrame,
    bounds: tuple[float, float, float, float],
    *,
    grid_km: float,
    prefix: str,
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """Patch id of each point of a regular grid by arithmetic; NULL outside the box. No join."""
    min_lon, min_lat, max_lon, max_lat = bounds
    step = grid_km / KM_PER_DEGREE
    inside = F.col(lon).between(min_lon, max_lon) & F.col(lat).between(min_lat, max_lat)
    inside = inside & (F.col(lon) < max_lon) & (F.col(lat) < max_lat)
    row = F.floor((F.col(lat) - min_lat) / F.lit(step)).cast("int")
    col = F.floor((F.col(lon) - min_lon) / F.lit(step)).cast("int")
    return points.withColumn(
        "patch_id", F.when(inside, F.concat_ws("_", F.lit(prefix), row.cast("string"), col.cast("string")))
    )


def assign_rectangles(
    points: DataFrame, patches: DataFrame, *, cell: float, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Points in irregular rectangles [min, max): equi join on cells of ``cell`` degrees.

    Pick ``cell`` near the usual rectangle size: each rectangle is listed once per
    cell it touches, each point has one cell.
    """

    def cells(low: str, high: str):
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    listed = patches.select("patch_id", "min_lon", "min_lat", "max_lon", "max_lat", cells("min_lon", "max_lon").alias("_cx"))
    listed = listed.withColumn("_cy", cells("min_lat", "max_lat"))
    placed = points.withColumn("_cx", F.floor(F.col(lon) / cell)).withColumn("_cy", F.floor(F.col(lat) / cell))
    inside = (
        (F.col(lon) >= F.col("min_lon"))
        & (F.col(lon) < F.col("max_lon"))
        & (F.col(lat) >= F.col("min_lat"))
        & (F.col(lat) < F.col("max_lat"))
    )
    return placed.join(listed, ["_cx", "_cy"]).filter(inside).select(*points.columns, "patch_id")
