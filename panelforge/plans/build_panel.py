"""The panel build: spine, source summaries, labels, features, keys."""

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import composites as comp
from ..operators.features import rolling_stats, spectral_indices
from ..operators.keys import KEYS, finish_keys
from ..operators.labels import occurrence_labels, severity_labels
from ..operators.lookups import static_join
from ..operators.windows import Daily, Span, counted, image_spans, images_counted, span_rollups, within_period


def build_panel(
    spine: DataFrame,
    sources: Mapping[str, DataFrame],
    *,
    lookback_days: int,
    bands: Sequence[str] = ("b2", "b3", "b4", "b8", "b11", "b12"),
    weather: Sequence[str] = ("temperature_2m", "total_precipitation_sum"),
    weather_cell: str = "patch_id",
    period: tuple[str, str] | None = None,
    chunk_rows: int = comp.CHUNK_ROWS,
    ends: Mapping[str, int] | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """Canonical panel of a spine from the sources that are given.

    Sources: ``viirs_active_fire``, ``sentinel2_sr``, ``sentinel2_cloud_probability``,
    ``cloud_score_plus``, ``era5_land_daily``, ``srtm``, ``burn_severity`` (burn rows;
    its bands come from ``sentinel2_sr``). ``period`` gives the first and last reference date where they
    are known, so that scans skip observations no window can reach. ``ends`` moves the end of a
    source's look-back by days; beyond 0 it looks ahead.

    The latest day of any observation that a look-back summary really used becomes ``feature_max_timestamp``: each source
    carries it through the window of its own summary, so the leakage check finds a window that reaches too far.

    Counts, images and burns of all sources are rolled up in one window over keys; summaries are
    made on keys alone and meet once, before the row's other columns join. ``keep`` is given each summary and its name: with
    ``session.settled`` they are made one after the other, and what one of them shuffles is gone when the next begins.
    """
    ends = dict(ends or {})
    needs = {"burn_severity": "sentinel2_sr"}
    for name, other in needs.items():
        if name in sources and other not in sources:
            raise ValueError(f"source {name} needs {other}, which holds its bands")
    if period is not None:
        sources = _in_period(sources, period, lookback_days, max([0, *ends.values()]))
    keys = spine.select(*KEYS)
    parts: list[Daily] = []
    spans: dict[str, Span] = {}
    counts, images, seen, tables = [], [], [], []

    def roll(part: Daily, named: Mapping[str, Span], *numbers: str) -> None:
        parts.append(part)
        spans.update(named)
        counts.extend(numbers)

    def reach(name: str) -> dict:
        seen.append(f"_seen_{name}")
        return {"ends": ends.get(name, 0), "last_seen": seen[-1]}

    if "viirs_active_fire" in sources:
        past, at = f"temporal_fire_past_count_l{lookback_days}d", reach("viirs_active_fire")
        part, named = comp.event_spans(sources["viirs_active_fire"], window=(-lookback_days, at["ends"]), past=past, last_seen=at["last_seen"])
        roll(part, named, *[n for n in named if n != at["last_seen"]])
    if "sentinel2_sr" in sources:
        optical, at = sources["sentinel2_sr"], reach("sentinel2_sr")
        seen.append("_seen_images")
        window, count = (-lookback_days, at["ends"]), "optical_s2_observation_count"
        part, named = image_spans(optical, window=window, out=count, last_seen="_seen_images")
        roll(replace(part, events=keep(part.events, "images")), named)
        images.append(count)
        tables.append(keep(comp.optical_medians(keys, optical, bands, lookback_days=lookback_days, chunk_rows=chunk_rows, **at), "optical"))
    if "burn_severity" in sources:
        roll(*comp.burn_spans(sources["burn_severity"], out="_doy"))
    if "sentinel2_cloud_probability" in sources:
        clouds = sources["sentinel2_cloud_probability"]
        tables.append(keep(comp.cloud_probability(keys, clouds, lookback_days=lookback_days, **reach("sentinel2_cloud_probability")), "clouds"))
    if "cloud_score_plus" in sources:
        tables.append(keep(comp.cloud_score(keys, sources["cloud_score_plus"], lookback_days=lookback_days, **reach("cloud_score_plus")), "scores"))
    if "era5_land_daily" in sources:
        # weather cells are coarser than patches: summarise each cell once, then look it up
        places = [weather_cell, "reference_date"]
        cells = spine.select(*places).distinct()
        summary = comp.mean_composite(
            cells, sources["era5_land_daily"], weather, lookback_days=lookback_days, entity=weather_cell, **reach("era5_land_daily")
        )
        mine = spine.select(*dict.fromkeys([*KEYS, weather_cell])).join(keep(summary, "weather"), places, "left")
        tables.append(mine if weather_cell == "patch_id" else mine.drop(weather_cell))
    rolled = keys
    if parts:
        rolled = counted(span_rollups(keys, parts, spans), *counts)
        for count in images:
            rolled = images_counted(rolled, count)
        rolled = keep(rolled, "rolled")
    if "burn_severity" in sources:
        burned = comp.with_burn_date(rolled, "_doy")
        rolled = comp.pre_post_composites(burned, sources["sentinel2_sr"], chunk_rows=chunk_rows, keep=keep)
    for table in tables:
        rolled = rolled.join(table, KEYS, "left")
    whole = static_join(spine, comp.terrain_means(sources["srtm"])) if "srtm" in sources else spine
    out = whole.join(rolled, KEYS, "left") if parts or tables else whole
    latest = F.greatest(*[F.col(s) for s in seen]) if len(seen) > 1 else (F.col(seen[0]) if seen else F.lit(None))
    out = out.withColumn("feature_max_timestamp", F.coalesce(latest.cast("date"), F.col("reference_date"))).drop(*seen)
    out = severity_labels(occurrence_labels(out))
    return finish_keys(rolling_stats(spectral_indices(out)))


def _in_period(sources: Mapping[str, DataFrame], period: tuple[str, str], lookback_days: int, ahead: int = 0) -> dict[str, DataFrame]:
    """Sources cut to the days their windows can reach. Optical rows also serve burns,
    whose date lies within a year of the window start, 90 days before to 120 after."""
    reach = {
        "viirs_active_fire": ("obs_date", -lookback_days, max(*comp.HORIZONS, ahead)),
        "sentinel2_cloud_probability": ("obs_date", -lookback_days, ahead),
        "cloud_score_plus": ("obs_date", -lookback_days, ahead),
        "era5_land_daily": ("obs_date", -lookback_days, ahead),
        "burn_severity": ("image_date", 1, 90),
        "sentinel2_sr": ("obs_date", -lookback_days, ahead),
    }
    if "burn_severity" in sources:
        longest = 366 + comp.PREFIRE_DAYS
        reach["sentinel2_sr"] = ("obs_date", -max(lookback_days, longest), 366 + comp.POSTFIRE_END)
    return {
        name: within_period(df, *period, first=reach[name][1], last=reach[name][2], day=reach[name][0])
        if name in reach
        else df
        for name, df in sources.items()
    }
