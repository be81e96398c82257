"""Which observation tables exist, and which of their columns are read."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.missing import nulls_for_nans

# Public dataset names by source.
DATASETS = {
    "sentinel2_sr": "COPERNICUS/S2_SR_HARMONIZED",
    "sentinel2_cloud_probability": "COPERNICUS/S2_CLOUD_PROBABILITY",
    "cloud_score_plus": "GOOGLE/CLOUD_SCORE_PLUS/V1/S2_HARMONIZED",
    "era5_land_daily": "ECMWF/ERA5_LAND/DAILY_AGGR",
    "viirs_active_fire": "NASA/LANCE/SNPP_VIIRS/C2",
    "modis_burned_area": "MODIS/061/MCD64A1",
    "burn_severity": "MODIS/061/MCD64A1",
    "srtm": "CGIAR/SRTM90_V4",
    "dynamic_world": "GOOGLE/DYNAMICWORLD/V1",
    "worldpop": "WorldPop/GP/100m/pop",
    "ghsl_built_surface": "JRC/GHSL/P2023A/GHS_BUILT_S",
}

# Measured columns by source, for configurations that name none.
FALLBACK_BANDS = {
    "sentinel2_sr": ["b2", "b3", "b4", "b8", "b11", "b12"],
    "sentinel2_cloud_probability": ["probability"],
    "cloud_score_plus": ["cs", "cs_cdf"],
    "era5_land_daily": ["temperature_2m", "total_precipitation_sum"],
    "viirs_active_fire": ["fire_mask"],
    "burn_severity": ["burn_doy"],
    "srtm": ["elevation"],
}
BAND_KEY = {
    "sentinel2_cloud_probability": "required_properties",
    "cloud_score_plus": "required_properties",
    "era5_land_daily": "variables",
}
KEY_COLUMNS = ["patch_id", "cell", "pixel_id", "image_id", "obs_date", "image_date"]


@dataclass(frozen=True)
class ObservationSource:
    name: str
    dataset_id: str
    role: str
    bands: list[str]
    frame: DataFrame


def band_list(values: Sequence[str] | None, fallback: Sequence[str]) -> list[str]:
    """Configured names, or the fallback when there are none or one is still a ``TODO_``."""
    if not values or any(v.startswith("TODO_") for v in values):
        return list(fallback)
    return [v.lower() for v in values]


def observation_sources(spark: SparkSession, config: Mapping[str, Mapping[str, Any]]) -> dict[str, ObservationSource]:
    """Enabled sources with a lazy scan of keys and bands only (``path`` per source)."""
    found = {}
    for name, cfg in config.items():
        if not cfg.get("enabled", False):
            continue
        bands = band_list(cfg.get(BAND_KEY.get(name, "required_bands")), FALLBACK_BANDS.get(name, []))
        table = spark.read.parquet(cfg["path"])
        keep = [c for c in KEY_COLUMNS + bands if c in table.columns]
        found[name] = ObservationSource(
            name=name,
            dataset_id=str(cfg.get("dataset_id", DATASETS.get(name, "UNKNOWN"))),
            role=str(cfg.get("role", "")),
            bands=bands,
            frame=nulls_for_nans(table.select(*keep)),
        )
    return found
