"""Joining a spine with dated observations.

Three ways:

* ``span_rollups`` for measures that can be summed or maximised per day first:
  observations shrink to one row per patch and day before the shuffle, then one
  range-framed window gives any number of look-back and future spans. No join,
  and no row is multiplied. A window group is bounded by the calendar (days of
  observations plus reference dates of one patch), whatever the raw row count.
* ``pixels.pixel_windows`` and ``pixel_totals`` for per-pixel statistics: rows of a stretch of time are sorted
  beside the anchors that see them. An observation is moved once or twice,
  not once per window that covers it (26 times for weekly dates and 180 days).
* ``span_join`` where the pairs themselves are wanted: an equi join on patch and
  time bucket. Buckets are as wide as the span, so an anchor touches two at most
  and every observation has exactly one.
"""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def within_period(
    observations: DataFrame, start: str, end: str, *, first: int, last: int, day: str = "obs_date"
) -> DataFrame:
    """Only observations that some anchor in [start, end] can see ``first..last`` days away.

    Both bounds are constants, so they reach the scan and skip files and row groups.
    """
    low, high = F.date_add(F.lit(start).cast("date"), first), F.date_add(F.lit(end).cast("date"), last)
    return observations.filter((F.col(day) >= low) & (F.col(day) <= high))


@dataclass(frozen=True)
class Daily:
    """Rows of one source and the aggregates that shrink them to one row per entity and day."""

    events: DataFrame
    measures: Mapping[str, Column]
    day: str = "obs_date"


Span = tuple[str, str, int | None, int | None]


def span_rollups(
    spine: DataFrame,
    sources: Sequence[Daily],
    spans: Mapping[str, Span],
    *,
    entity: str = "patch_id",
    anchor: str = "reference_date",
) -> DataFrame:
    """Aggregate the daily measures of several sources in day spans around every spine row, in one window.

    Measures must have different names. ``spans`` maps an output column to ``(daily measure,
    sum|max|min, first day, last day)`` with days relative to the anchor, both included, None
    for unbounded. Sums over spans without events are NULL; callers choose their own zero rule.
    """
    rows = spine.select("*", F.col(anchor).alias("_day"), F.lit(True).alias("_spine"))
    days: list[DataFrame] = []
    for source in sources:
        measures = [c.alias(f"_m_{n}") for n, c in source.measures.items()]
        days.append(source.events.groupBy(entity, F.col(source.day).alias("_day")).agg(*measures))
    if days:
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), days)
        if len(days) > 1:  # one row per day of all sources; their tasks hold the same days, so nothing moves for it
            every = every.groupBy(entity, "_day").agg(*[F.max(c).alias(c) for c in every.columns if c.startswith("_m_")])
        rows = rows.unionByName(every.withColumn("_spine", F.lit(False)), allowMissingColumns=True)
    by_day = Window.partitionBy(entity).orderBy(day_number(F.col("_day")))

    def frame(first: int | None, last: int | None):
        return by_day.rangeBetween(
            Window.unboundedPreceding if first is None else first,
            Window.unboundedFollowing if last is None else last,
        )

    outputs = [COMBINE[fn](f"_m_{m}").over(frame(a, b)).alias(name) for name, (m, fn, a, b) in spans.items()]
    return rows.select(*spine.columns, "_spine", *outputs).filter("_spine").drop("_spine")


def span_rollup(
    spine: DataFrame,
    events: DataFrame,
    *,
    daily: Mapping[str, Column],
    spans: Mapping[str, Span],
    day: str = "obs_date",
    entity: str = "patch_id",
    anchor: str = "reference_date",
) -> DataFrame:
    """``span_rollups`` of a single source."""
    return span_rollups(spine, [Daily(events, daily, day)], spans, entity=entity, anchor=anchor)


def span_join(
    anchors: DataFrame,
    observations: DataFrame,
    *,
    first: int,
    last: int,
    entity: str = "patch_id",
    anchor: str = "reference_date",
    day: str = "obs_date",
) -> DataFrame:
    """Inner pairs of anchors and the entity's observations ``first..last`` days away.

    Inner, so that adaptive execution may split a skewed bucket on either side;
    unmatched anchors come back in the caller's final left join.
    """
    width = last - first + 1
    at = day_number(F.col(anchor))
    low, high = F.floor((at + first) / width), F.floor((at + last) / width)
    left = anchors.withColumn("_bucket", F.explode(F.array_distinct(F.array(low, high))))
    right = observations.withColumn("_bucket", F.floor(day_number(F.col(day)) / width))
    away = F.datediff(F.col(day), F.col(anchor))
    return left.join(right, [entity, "_bucket"]).filter(away.between(first, last)).drop("_bucket")


def image_spans(
    observations: DataFrame,
    *,
    window: tuple[int, int],
    out: str,
    last_seen: str | None = None,
    entity: str = "patch_id",
    day: str = "obs_date",
    image: str = "image_id",
    prefix: str = "image",
) -> tuple[Daily, dict[str, Span]]:
    """Source and spans that count distinct images whose day lies in ``window`` around an anchor; see ``images_counted``.

    An image dated d counts for anchors d - last .. d - first, but only up to the day before
    its next date would count, so that it counts once. Nearly all dates count for the whole interval: they are summed in
    the window itself, a row each. Where the next date comes sooner, one is taken back from then on and given back after the
    interval; per-day sums of these steps and one running sum give exact distinct counts without a range join.
    ``last_seen`` adds the latest image day that the window really reached.
    """
    first, last = window
    dated = observations.select(entity, image, day)
    following = F.lead(day).over(Window.partitionBy(image, entity).orderBy(day))  # sorted by image first, which differs most
    dates = dated.select(entity, F.col(day).alias("_at"), following.alias("_following"))
    dates = dates.select(entity, "_at", F.date_add("_at", 1 - first).alias("_end"), F.date_add("_following", -last).alias("_next"))

    def row(at: Column, n: Column, step: Column) -> Column:
        return F.struct(at.alias("obs_date"), n.cast("int").alias("n"), step.cast("int").alias("step"))

    none, no_day = F.lit(None), F.col("_at").isNull()
    # a row without a day counts from the first day on, until the image has one
    begun, ended = row(F.col("_at"), none, F.lit(1)), row(F.coalesce("_next", F.lit("9999-12-31").cast("date")), none, F.lit(-1))
    whole = row(F.col("_at"), F.lit(1), none)
    cut = F.array(whole, row(F.col("_next"), none, F.lit(-1)), row(F.col("_end"), none, F.lit(1)))
    steps = dates.select(entity, F.inline(F.when(no_day, F.array(begun, ended)).when(F.col("_next") < F.col("_end"), cut).otherwise(F.array(whole))))
    measures = {f"{prefix}_n": F.sum("n"), f"{prefix}_step": F.sum("step")}
    spans: dict[str, Span] = {out: (f"{prefix}_n", "sum", first, last), _cut(out): (f"{prefix}_step", "sum", None, 0)}
    if last_seen:
        measures[f"{prefix}_at"] = F.max(F.when(F.col("n") > 0, F.col("obs_date")))
        spans[last_seen] = (f"{prefix}_at", "max", first, last)
    return Daily(steps, measures), spans


def _cut(out: str) -> str:
    return f"_cut_{out}"


def images_counted(rolled: DataFrame, out: str) -> DataFrame:
    """The number of images of both spans of ``image_spans``, 0.0 without any."""
    both = F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col(_cut(out)), F.lit(0))
    return rolled.withColumn(out, both.cast("double")).drop(_cut(out))


def counted(df: DataFrame, *names: str) -> DataFrame:
    """Counts as doubles, 0.0 where nothing was counted."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in names})


def image_counts(
    spine: DataFrame,
    observations: DataFrame,
    *,
    lookback_days: int,
    out: str,
    entity: str = "patch_id",
    anchor: str = "reference_date",
    ends: int = 0,
    last_seen: str | None = None,
) -> DataFrame:
    """Distinct images in [ref - L, ref + ends] as a double, 0.0 when none."""
    source, spans = image_spans(observations, window=(-lookback_days, ends), out=out, last_seen=last_seen, entity=entity)
    return images_counted(span_rollups(spine, [source], spans, entity=entity, anchor=anchor), out)
