"""Observation summaries per patch and date."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import normalized_difference
from ..functions.missing import nulls_for_nans
from .keys import KEYS
from .pixels import MEDIAN, SUM, pixel_totals, pixel_windows
from .windows import Daily, Span, counted, day_number, image_counts, span_rollups

FIRE_THRESHOLD = 7  # fixed value: mask classes from here on are fires
HORIZONS = (7, 30, 60)
PREFIRE_DAYS = 90
POSTFIRE_START, POSTFIRE_END = 30, 120
CHUNK_ROWS = 10_000  # observations of one pixel and stretch of time that are sorted together
CROWDED = 10_000  # fullest stretches that are looked for


def crowded_pixels(rows: DataFrame, width: int, chunk_rows: int) -> DataFrame:
    """Pixels with more than ``chunk_rows`` rows in a stretch of ``width`` days, and over how many chunks to deal them.

    The ``CROWDED`` fullest stretches are looked up, a table of bounded size; any other
    holds less than that share of all rows. Only pixels that have as many rows in all are counted by stretch.
    """
    keys = ["patch_id", "pixel_id", "_stretch"]
    many = rows.groupBy("patch_id", "pixel_id").agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > chunk_rows)
    # one in chunk_rows rows at most: the rows themselves are not moved to find them
    many = F.broadcast(many.select("patch_id", "pixel_id"))
    places = rows.select("patch_id", "pixel_id", "obs_date").join(many, ["patch_id", "pixel_id"], "left_semi")
    placed = places.select("patch_id", "pixel_id", F.floor(day_number(F.col("obs_date")) / width).alias("_stretch"))
    fullest = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk_rows)
    fullest = fullest.orderBy(F.desc("_n"), *keys).limit(CROWDED)
    return fullest.groupBy("patch_id", "pixel_id").agg(F.ceil(F.max("_n") / chunk_rows).cast("int").alias("chunks"))


def _middle(values: Column) -> tuple[Column, Column]:
    """Lower and upper middle of a sorted array; NULL when it is empty."""
    n = F.size(values)
    return F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))


def _merged_medians(parts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Medians of pixels whose sorted values (array columns ``names``) lie in several rows, one per chunk.

    The median lies between the least lower and the greatest upper middle of the chunks. As
    rows are dealt by hash, these are close, and only the distinct values between them meet. The parts, which
    cost a sort and a worker, are read once.
    """
    group = [*keys, "name"]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("values")) for n in names])
    long = parts.select(*keys, F.inline(pairs)).filter(F.size("values") > 0)
    low, high = _middle(F.col("values"))
    whole = Window.partitionBy(*group)
    ends = [F.sum(F.size("values")).over(whole).alias("n"), F.min(low).over(whole).alias("low"), F.max(high).over(whole).alias("high")]
    near = F.filter("values", lambda v: v.between(F.col("low"), F.col("high")))
    less = F.size(F.filter("values", lambda v: v < F.col("low"))).cast("long")
    # the values below come first, as so many rows of no value
    values = F.concat(F.array(F.struct(F.lit(None).cast("double").alias("value"), less.alias("c"))), F.transform(near, lambda v: F.struct(v.alias("value"), F.lit(1).cast("long").alias("c"))))
    one = long.select(*group, "values", *ends).select(*group, "n", F.inline(values))
    counted = one.groupBy(*group, "value").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy(F.col("value").asc_nulls_first()))
    ranked = counted.withColumn("upto", upto)

    def holds(rank: Column) -> Column:
        return (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c"))

    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    median = (F.max(F.when(holds(first), F.col("value"))) + F.max(F.when(holds(second), F.col("value")))) / 2
    found = ranked.groupBy(*group).agg(median.alias("median"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in names])


def median_over_spans(
    anchors: DataFrame,
    observations: DataFrame,
    bands: Sequence[str],
    spans: Mapping[str, tuple[int, int]],
    *,
    anchor: str = "reference_date",
    chunk_rows: int = CHUNK_ROWS,
    last_seen: str | None = None,
) -> DataFrame:
    """Median over time per pixel, then mean over pixels, in columns ``<span>_<band>``.

    ``last_seen`` adds the latest day of a value that went into any of them.

    A pixel with more than ``chunk_rows`` observations in a stretch is cut into chunks by hash,
    whose medians bound the pixel's, so no task holds a crowded pixel. NaN counts as missing.
    """
    low, high = min(a for a, _ in spans.values()), max(z for _, z in spans.values())
    narrow = nulls_for_nans(observations.select("patch_id", "pixel_id", "obs_date", *bands))
    crowded = crowded_pixels(narrow, high - low + 1, chunk_rows)
    pixel = ["patch_id", "pixel_id"]
    names = [f"{s}_{b}" for s in spans for b in bands]
    counts = [f"{n}_pixels" for n in names]
    keys = ["patch_id", anchor, "pixel_id"]
    usual = narrow.join(F.broadcast(crowded), pixel, "left").filter("chunks is null").drop("chunks")
    whole = pixel_totals(anchors, usual, bands, spans, statistic=MEDIAN, anchor=anchor).select("patch_id", anchor, *names, *counts, "seen")
    # without crowded pixels all that follows is empty, and adaptive execution leaves it out
    full = narrow.join(F.broadcast(crowded), pixel)
    most = crowded.groupBy("patch_id").agg(F.max("chunks").alias("chunks"))
    near = anchors.select("patch_id", anchor).join(F.broadcast(most), "patch_id")
    parts = pixel_windows(near, full, bands, spans, statistic=MEDIAN, anchor=anchor, dealt=True)
    parts = parts.select(*keys, *[F.col(f"{n}_values").alias(n) for n in names], "seen")
    merged = _merged_medians(parts, keys, names)
    ones = [F.col(n).isNotNull().cast("long").alias(f"{n}_pixels") for n in names]
    medians = whole.unionByName(merged.select("patch_id", anchor, *names, *ones, F.lit(None).cast("date").alias("seen")))
    if last_seen:
        medians = medians.unionByName(parts.select("patch_id", anchor, "seen"), allowMissingColumns=True)
    seen = [F.max("seen").alias(last_seen)] if last_seen else []
    means = [F.try_divide(F.sum(n), F.sum(c)).alias(n) for n, c in zip(names, counts)]
    return medians.groupBy("patch_id", anchor).agg(*means, *seen)


def _latest(df: DataFrame, out: str | None, *names: str) -> DataFrame:
    """Put the latest of the ``names`` days into ``out``, and take them away."""
    return df.withColumn(out, F.greatest(*names)).drop(*names) if out else df


def optical_medians(
    keys: DataFrame, observations: DataFrame, bands: Sequence[str], *, lookback_days: int, prefix: str = "optical",
    ends: int = 0, last_seen: str | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Look-back medians alone, of keys that have any."""
    means = median_over_spans(keys, observations, bands, {"past": (-lookback_days, ends)}, chunk_rows=chunk_rows, last_seen=last_seen)
    return means.withColumnsRenamed({f"past_{b}": f"{prefix}_{b}_mean_l{lookback_days}d" for b in bands})


def median_composite(
    spine: DataFrame,
    observations: DataFrame,
    bands: Sequence[str] = ("b2", "b3", "b4", "b8", "b11", "b12"),
    *,
    lookback_days: int,
    prefix: str = "optical",
    count_name: str = "optical_s2_observation_count",
    ends: int = 0,
    last_seen: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Optical look-back composite; windows without images keep NULL bands and count 0.0."""
    images, values = ("_seen_images", "_seen_values") if last_seen else (None, None)
    named = optical_medians(
        spine.select(*KEYS), observations, bands, lookback_days=lookback_days, prefix=prefix, ends=ends, last_seen=values, chunk_rows=chunk_rows
    )
    images_of = image_counts(spine, observations, lookback_days=lookback_days, out=count_name, ends=ends, last_seen=images)
    return _latest(images_of.join(named, KEYS, "left"), last_seen, *([images, values] if last_seen else []))


def mean_composite(
    spine: DataFrame,
    observations: DataFrame,
    fields: Sequence[str],
    *,
    lookback_days: int,
    name: str = "weather_{field}_mean_l{days}d",
    count_name: str = "weather_era5_obs_count",
    entity: str = "patch_id",
    ends: int = 0,
    last_seen: str | None = None,
) -> DataFrame:
    """Mean over time per pixel, then mean over pixels; pixels weigh the same. The look-back is [ref - L, ref + ends].

    ``last_seen`` adds the latest observation day that a mean or the image count used.

    Sums and counts per pixel and day are taken first, so a pixel with a huge number
    of observations is one row per day from there on.
    """
    keys = [entity, "reference_date"]
    per_day = observations.groupBy(entity, "pixel_id", "obs_date").agg(
        *[F.sum(f).alias(f"_s_{f}") for f in fields], *[F.count(f).alias(f"_n_{f}") for f in fields]
    )
    parts = [f"_{part}_{f}" for f in fields for part in ("s", "n")]
    found = pixel_totals(spine, per_day, parts, {"past": (-lookback_days, ends)}, statistic=SUM, entity=entity)
    means = found.groupBy(*keys).agg(
        *[F.try_divide(F.sum(f"past__s_{f}"), F.sum(f"past__s_{f}_pixels")).alias(name.format(field=f, days=lookback_days)) for f in fields],
        *([F.max("seen").alias("_seen_values")] if last_seen else []),
    )
    images = "_seen_images" if last_seen else None
    images_of = image_counts(spine, observations, lookback_days=lookback_days, out=count_name, entity=entity, ends=ends, last_seen=images)
    return _latest(images_of.join(means, keys, "left"), last_seen, *([images, "_seen_values"] if last_seen else []))


def cloud_probability(
    spine: DataFrame, observations: DataFrame, *, lookback_days: int, band: str = "probability", **reach
) -> DataFrame:
    return mean_composite(
        spine,
        observations.withColumnRenamed(band, "probability"),
        ["probability"],
        lookback_days=lookback_days,
        name="optical_cloud_{field}_mean_l{days}d",
        count_name="optical_cloud_probability_obs_count",
        **reach,
    )


def cloud_score(
    spine: DataFrame, observations: DataFrame, *, lookback_days: int, fields: Sequence[str] = ("cs", "cs_cdf"), **reach
) -> DataFrame:
    """Clear-score means; a field the observations lack comes out NULL."""
    for f in fields:
        if f not in observations.columns:
            observations = observations.withColumn(f, F.lit(None).cast("double"))
    return mean_composite(
        spine,
        observations,
        list(fields),
        lookback_days=lookback_days,
        name="optical_cloudscore_{field}_mean_l{days}d",
        count_name="optical_cloudscore_obs_count",
        **reach,
    )


def terrain_means(terrain: DataFrame, bands: Sequence[str] = ("elevation",)) -> DataFrame:
    """Static mean per patch and band."""
    return terrain.groupBy("patch_id").agg(*[F.avg(b).alias(f"terrain_{b}_mean") for b in bands])


def event_spans(
    fires: DataFrame,
    *,
    window: tuple[int, int],
    past: str,
    horizons: Sequence[int] = HORIZONS,
    threshold: int = FIRE_THRESHOLD,
    mask: str = "fire_mask",
    last_seen: str | None = None,
) -> tuple[Daily, dict[str, Span]]:
    """Source and spans of the past count and the nested future counts of fire pixels.

    ``last_seen`` is the latest observation day in the very frame of the past count.
    """
    spans: dict[str, Span] = {past: ("hits", "sum", *window)}
    spans |= {f"viirs_future_fire_count_{h}d": ("hits", "sum", 1, h) for h in horizons}
    daily = {"hits": F.count_if(F.col(mask) >= threshold)}
    if last_seen is not None:
        daily["fire_at"] = F.max("obs_date")
        spans[last_seen] = ("fire_at", "max", *window)
    else:
        # only fires matter: the filter reaches the scan
        fires = fires.filter(F.col(mask) >= threshold)
    return Daily(fires, daily), spans


def past_future_event_counts(
    spine: DataFrame,
    fires: DataFrame,
    *,
    lookback_days: int,
    horizons: Sequence[int] = HORIZONS,
    threshold: int = FIRE_THRESHOLD,
    mask: str = "fire_mask",
    ends: int = 0,
    last_seen: str | None = None,
) -> DataFrame:
    """Past count and nested future counts of fire pixels, all from one window pass.

    ``last_seen`` names an extra column with the latest observation day used by
    the look-back span, which the leakage check compares with the reference date.
    """
    past = f"temporal_fire_past_count_l{lookback_days}d"
    source, spans = event_spans(
        fires, window=(-lookback_days, ends), past=past, horizons=horizons, threshold=threshold, mask=mask, last_seen=last_seen
    )
    return counted(span_rollups(spine, [source], spans), *[c for c in spans if c != last_seen])


def burn_spans(burns: DataFrame, *, out: str, horizon_days: int = 60, slack_days: int = 31) -> tuple[Daily, dict[str, Span]]:
    """Source and span of the latest burn day-of-year among images dated [ref+1, ref+H+31)."""
    return Daily(burns, {"doy": F.max("burn_doy")}, "image_date"), {out: ("doy", "max", 1, horizon_days + slack_days - 1)}


def with_burn_date(rolled: DataFrame, doy: str) -> DataFrame:
    """Replace the day-of-year by a date in the year of ref+1; without a positive one it is NULL.

    Kept as is: the year is that of the window start, so a burn after New Year
    lands a year early.
    """
    start_year = F.trunc(F.date_add("reference_date", 1), "year")
    day = F.col(doy).cast("int")
    return rolled.withColumn("burn_date", F.when(day > 0, F.date_add(start_year, day - 1))).drop(doy)


def burn_date(spine: DataFrame, burns: DataFrame, *, horizon_days: int = 60, slack_days: int = 31) -> DataFrame:
    """Date of the latest burn after each reference date; see ``with_burn_date``."""
    source, spans = burn_spans(burns, out="_doy", horizon_days=horizon_days, slack_days=slack_days)
    return with_burn_date(span_rollups(spine, [source], spans), "_doy")


def pre_post_composites(
    burned: DataFrame,
    observations: DataFrame,
    *,
    nir: str = "b8",
    swir2: str = "b12",
    prefire_days: int = PREFIRE_DAYS,
    postfire: tuple[int, int] = (POSTFIRE_START, POSTFIRE_END),
    chunk_rows: int = CHUNK_ROWS,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """Composites before and after each burn, with burn ratios and their difference.

    Many reference dates share a burn, so medians are taken once per patch and
    burn date, both windows from the same arrays. ``keep`` may write them and read them back.
    """
    anchors = burned.filter("burn_date is not null").select("patch_id", "burn_date").distinct()
    spans = {"pre": (-prefire_days, -1), "post": postfire}
    medians = keep(median_over_spans(anchors, observations, [nir, swir2], spans, anchor="burn_date", chunk_rows=chunk_rows), "burns")
    wide = medians.withColumnsRenamed(
        {
            f"pre_{nir}": "prefire_nir_mean",
            f"pre_{swir2}": "prefire_swir2_mean",
            f"post_{nir}": "postfire_nir_mean",
            f"post_{swir2}": "postfire_swir2_mean",
        }
    )
    out = burned.join(wide, ["patch_id", "burn_date"], "left").withColumns(
        {
            "prefire_nbr": normalized_difference(F.col("prefire_nir_mean"), F.col("prefire_swir2_mean")),
            "postfire_nbr": normalized_difference(F.col("postfire_nir_mean"), F.col("postfire_swir2_mean")),
        }
    )
    return out.withColumn("dnbr", F.col("prefire_nbr") - F.col("postfire_nbr"))
