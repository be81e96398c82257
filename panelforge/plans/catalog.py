"""Registered queries: each operator over the given tables, with its SQL equivalent.

All queries read whole tables. Doubles are rounded on both sides, as sums may run
in any order.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import uniform_edges
from ..operators import checks, composites, curves, features, holdout, keys, labels, lookups, metrics, ordered, splits
from ..session import discard, settled
from ..streaming.incremental import pending_keys
from . import bindings as b
from .bindings import LOOKBACK, Tables, rnd, rounded, with_views
from .build_panel import build_panel
from .evaluate import evaluate_all, research_curves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPLIT_ENDS = dict(train_end=b.TRAIN_END, val_end=b.VAL_END, test_end=b.TEST_END)
SPLIT_SQL = (
    f"CASE WHEN reference_date <= DATE '{b.TRAIN_END}' THEN 'train' "
    f"WHEN reference_date <= DATE '{b.VAL_END}' THEN 'val' ELSE 'test' END"
)


def query(name: str, sql: str | None = None):
    """Register ``fn(Tables) -> DataFrame`` under a name, with its SQL if there is one."""

    def keep(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def _literals(values: list[float]) -> str:
    return ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(values))


def _round_but(df: DataFrame, *exact: str) -> DataFrame:
    """Round doubles, but leave the ``exact`` columns (literals and input values) alone."""
    return df.select(
        *[
            (F.round(c, 9) + F.lit(0.0)).alias(c) if k == "double" and c not in exact else F.col(c)
            for c, k in df.dtypes
        ]
    )


# --- keys ------------------------------------------------------------------

_rows, _cols, _step = keys.grid_shape(b.BOUNDS, b.GRID_KM)
_GRID_SQL = f"""(SELECT 'area_' || r || '_' || c AS patch_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "col",
    94e0 + c * {_step!r}::DOUBLE AS min_lon, -11e0 + r * {_step!r}::DOUBLE AS min_lat,
    least(94e0 + c * {_step!r}::DOUBLE + {_step!r}::DOUBLE, 141e0) AS max_lon,
    least(-11e0 + r * {_step!r}::DOUBLE + {_step!r}::DOUBLE, 6.5e0) AS max_lat
  FROM range({_rows}) a(r), range({_cols}) bb(c))"""
_ASSIGNED_SQL = f"""(SELECT o_orderkey,
    CASE WHEN lon >= 94e0 AND lon < 141e0 AND lat >= -11e0 AND lat < 6.5e0 THEN
      'area_' || CAST(floor((lat - -11e0) / {_step!r}::DOUBLE) AS INTEGER) || '_' ||
      CAST(floor((lon - 94e0) / {_step!r}::DOUBLE) AS INTEGER) END AS patch_id FROM points)"""


@query(
    "patch_grid",
    with_views(
        f"""SELECT g.patch_id, "row", "col", {rnd('min_lon')} AS min_lon, {rnd('min_lat')} AS min_lat,
          {rnd('max_lon')} AS max_lon, {rnd('max_lat')} AS max_lat, {rnd('(min_lon + max_lon) / 2')} AS centroid_lon,
          {rnd('(min_lat + max_lat) / 2')} AS centroid_lat, count(p.o_orderkey) AS n_points
        FROM {_GRID_SQL} g LEFT JOIN {_ASSIGNED_SQL} p ON g.patch_id = p.patch_id GROUP BY ALL""",
        "points",
    ),
)
def _(t: Tables) -> DataFrame:
    grid = keys.patch_grid(t.spark, b.BOUNDS, grid_km=b.GRID_KM, prefix="area")
    placed = lookups.assign_patch(t.points, b.BOUNDS, grid_km=b.GRID_KM, prefix="area")
    counted = placed.groupBy("patch_id").agg(F.count("*").alias("n_points"))
    return rounded(grid.join(counted, "patch_id", "left").fillna(0, ["n_points"]))


@query("assign_patch", with_views(f"SELECT o_orderkey, patch_id FROM {_ASSIGNED_SQL}", "points"))
def _(t: Tables) -> DataFrame:
    placed = lookups.assign_patch(t.points, b.BOUNDS, grid_km=b.GRID_KM, prefix="area")
    return placed.select("o_orderkey", "patch_id")


@query(
    "assign_rectangles",
    with_views(
        """SELECT patch_id, count(*) AS n_points FROM points JOIN patches
           ON lon >= min_lon AND lon < max_lon AND lat >= min_lat AND lat < max_lat GROUP BY patch_id""",
        "points",
        "patches",
    ),
)
def _(t: Tables) -> DataFrame:
    placed = lookups.assign_rectangles(t.points, t.patches, cell=0.045)
    return placed.groupBy("patch_id").agg(F.count("*").alias("n_points"))


@query(
    "panel_spine",
    with_views(
        f"""SELECT patch_id, reference_date, CAST(year(reference_date) AS INTEGER) AS reference_year,
          {rnd('min_lon')} AS static_min_lon, {rnd('min_lat')} AS static_min_lat, {rnd('max_lon')} AS static_max_lon,
          {rnd('max_lat')} AS static_max_lat, {rnd('(min_lon + max_lon) / 2e0')} AS centroid_lon,
          {rnd('(min_lat + max_lat) / 2e0')} AS centroid_lat,
          reference_date - {LOOKBACK} AS window_start, reference_date AS window_end,
          reference_date + 1 AS future_start, reference_date + 60 AS future_end FROM spine""",
        "spine",
    ),
)
def _(t: Tables) -> DataFrame:
    start, end = keys.lookback_window(F.col("reference_date"), LOOKBACK)
    first, last = keys.future_window(F.col("reference_date"), 60)
    out = keys.finish_keys(t.spine).drop("cell")
    return rounded(
        out.select("*", start.alias("window_start"), end.alias("window_end"), first.alias("future_start"), last.alias("future_end"))
    )


@query(
    "grid_coordinates",
    r"""SELECT patch_id, nullif(regexp_extract(patch_id, '^(.+)_(\d+)_(\d+)$', 1), '') AS grid_prefix,
          TRY_CAST(regexp_extract(patch_id, '^(.+)_(\d+)_(\d+)$', 2) AS INTEGER) AS grid_row,
          TRY_CAST(regexp_extract(patch_id, '^(.+)_(\d+)_(\d+)$', 3) AS INTEGER) AS grid_col
        FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE 'a_b_' || o_custkey || '_' || o_orderkey END AS patch_id FROM orders)""",
)
def _(t: Tables) -> DataFrame:
    made = F.concat_ws("_", F.lit("a_b"), "o_custkey", "o_orderkey")
    ids = t.table("orders").select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(made).alias("patch_id")
    )
    return keys.grid_coordinates(ids)


# --- span joins and composites ---------------------------------------------

_COUNT_NAMES = f"""past AS temporal_fire_past_count_l{LOOKBACK}d, c7 AS viirs_future_fire_count_7d,
  c30 AS viirs_future_fire_count_30d, c60 AS viirs_future_fire_count_60d"""


@query("past_future_event_counts", with_views(f"SELECT patch_id, reference_date, {_COUNT_NAMES} FROM counts", "counts"))
def _(t: Tables) -> DataFrame:
    return composites.past_future_event_counts(t.keys, t.sources["viirs_active_fire"], lookback_days=LOOKBACK)


@query(
    "past_future_event_counts_daily",
    with_views(
        f"""SELECT s.patch_id, s.reference_date,
          CAST(count(*) FILTER (WHERE obs_date <= reference_date) AS DOUBLE) AS temporal_fire_past_count_l7d,
          CAST(count(*) FILTER (WHERE obs_date = reference_date + 1) AS DOUBLE) AS viirs_future_fire_count_1d,
          CAST(count(*) FILTER (WHERE obs_date BETWEEN reference_date + 1 AND reference_date + 3) AS DOUBLE) AS viirs_future_fire_count_3d,
          CAST(count(*) FILTER (WHERE obs_date BETWEEN reference_date + 1 AND reference_date + 7) AS DOUBLE) AS viirs_future_fire_count_7d
        FROM (SELECT patch_id, CAST(d AS DATE) AS reference_date FROM (SELECT DISTINCT patch_id FROM event_fires),
                generate_series(DATE '{b.EVENT_START}', DATE '{b.EVENT_END}', INTERVAL 1 DAY) AS t(d)) s
        LEFT JOIN event_fires e ON s.patch_id = e.patch_id AND fire_mask >= 7
          AND obs_date BETWEEN reference_date - 7 AND reference_date + 7
        GROUP BY s.patch_id, s.reference_date""",
        "event_fires",
    ),
)
def _(t: Tables) -> DataFrame:
    dates = keys.date_steps(b.EVENT_START, b.EVENT_END, "1D")
    spine = t.event_fires.select("patch_id").distinct().withColumn("reference_date", F.explode(dates))
    return composites.past_future_event_counts(spine, t.event_fires, lookback_days=7, horizons=(1, 3, 7))


_BAND_SQL = ", ".join(f"{rnd(x, 6)} AS optical_{x}_mean_l{LOOKBACK}d" for x in b.BANDS)


@query(
    "median_composite",
    with_views(
        f"SELECT patch_id, reference_date, images AS optical_s2_observation_count, {_BAND_SQL} FROM counts LEFT JOIN optical USING (patch_id, reference_date)",
        "counts",
        "optical",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(composites.median_composite(t.keys, t.sources["sentinel2_sr"], b.BANDS, lookback_days=LOOKBACK), 6)


@query(
    "median_composite_hot_pixels",
    with_views(
        f"SELECT patch_id, reference_date, images AS optical_s2_observation_count, {rnd('b8', 6)} AS optical_b8_mean_l{LOOKBACK}d FROM counts LEFT JOIN optical USING (patch_id, reference_date)",
        "counts",
        "optical",
    ),
)
def _(t: Tables) -> DataFrame:
    # a low limit cuts the busier pixels into chunks
    return rounded(
        composites.median_composite(t.keys, t.sources["sentinel2_sr"], ["b8"], lookback_days=LOOKBACK, chunk_rows=4), 6
    )


@query(
    "mean_composite",
    with_views(
        f"""SELECT cell, reference_date, images AS weather_era5_obs_count, {rnd('mean', 6)} AS weather_temperature_2m_mean_l{LOOKBACK}d,
          {rnd('rain', 6)} AS weather_total_precipitation_sum_mean_l{LOOKBACK}d FROM cell_weather""",
        "cell_weather",
    ),
)
def _(t: Tables) -> DataFrame:
    cells = t.spine.select("cell", "reference_date").distinct()
    return rounded(
        composites.mean_composite(cells, t.weather, ["temperature_2m", "total_precipitation_sum"], lookback_days=LOOKBACK, entity="cell"), 6
    )


_PIXEL_MEANS = """FROM (SELECT s.patch_id, s.reference_date, pixel_id, avg({a}) AS a, avg({b}) AS b
      FROM spine s JOIN obs o ON s.patch_id = o.patch_id AND obs_date BETWEEN reference_date - 60 AND reference_date
      GROUP BY s.patch_id, s.reference_date, pixel_id) GROUP BY patch_id, reference_date"""


@query(
    "cloud_probability",
    with_views(
        f"""SELECT c.patch_id, c.reference_date, images AS optical_cloud_probability_obs_count,
          {rnd('m', 6)} AS optical_cloud_probability_mean_l{LOOKBACK}d
        FROM counts c LEFT JOIN (SELECT patch_id, reference_date, avg(a) AS m {_PIXEL_MEANS.format(a='b2', b='b2')}) x
          USING (patch_id, reference_date)""",
        "counts",
    ),
)
def _(t: Tables) -> DataFrame:
    clouds = t.observations.withColumnRenamed("b2", "probability")
    return rounded(composites.cloud_probability(t.keys, clouds, lookback_days=LOOKBACK), 6)


@query(
    "cloud_score",
    with_views(
        f"""SELECT c.patch_id, c.reference_date, images AS optical_cloudscore_obs_count,
          {rnd('m', 6)} AS optical_cloudscore_cs_mean_l{LOOKBACK}d, {rnd('k', 6)} AS optical_cloudscore_cs_cdf_mean_l{LOOKBACK}d
        FROM counts c LEFT JOIN (SELECT patch_id, reference_date, avg(a) AS m, avg(b) AS k {_PIXEL_MEANS.format(a='b2', b='b11')}) x
          USING (patch_id, reference_date)""",
        "counts",
    ),
)
def _(t: Tables) -> DataFrame:
    scores = t.observations.withColumnsRenamed({"b2": "cs", "b11": "cs_cdf"})
    return rounded(composites.cloud_score(t.keys, scores, lookback_days=LOOKBACK), 6)


@query(
    "static_join",
    with_views(f"SELECT patch_id, reference_date, {rnd('elevation')} AS terrain_elevation_mean FROM spine", "spine"),
)
def _(t: Tables) -> DataFrame:
    return rounded(lookups.static_join(t.keys, composites.terrain_means(t.terrain)))


@query(
    "merge_sources",
    with_views(
        f"""SELECT s.patch_id, s.reference_date, w.images AS weather_obs, {rnd('w.mean', 6)} AS measure,
          {rnd('s.elevation')} AS terrain_elevation_mean, past
        FROM spine s LEFT JOIN cell_weather w ON s.cell = w.cell AND s.reference_date = w.reference_date
        LEFT JOIN counts c ON s.patch_id = c.patch_id AND s.reference_date = c.reference_date""",
        "cell_weather",
        "counts",
    ),
)
def _(t: Tables) -> DataFrame:
    past = f"temporal_fire_past_count_l{LOOKBACK}d"
    fires = composites.past_future_event_counts(t.keys, t.sources["viirs_active_fire"], lookback_days=LOOKBACK)
    first = fires.select("patch_id", "reference_date", F.col(past).alias("past"), F.lit(-1.0).alias("measure"))
    cells = t.spine.select("cell", "reference_date").distinct()
    mean = composites.mean_composite(
        cells, t.weather, ["temperature_2m"], lookback_days=LOOKBACK, entity="cell", name="measure", count_name="weather_obs"
    )
    merged = lookups.merge_sources(
        t.spine.select("patch_id", "reference_date", "cell"),
        [first, composites.terrain_means(t.terrain), mean],
        ["patch_id", "reference_date", "cell"],
    )
    return rounded(merged.drop("cell"), 6, terrain_elevation_mean=9)


@query("burn_date", with_views("SELECT patch_id, reference_date, burn_date FROM burned", "burned"))
def _(t: Tables) -> DataFrame:
    return composites.burn_date(t.keys, t.burns)


@query(
    "pre_post_dnbr",
    with_views(
        f"""SELECT patch_id, reference_date, burn_date, {rnd('pre_nir', 6)} AS prefire_nir_mean,
          {rnd('pre_swir2', 6)} AS prefire_swir2_mean, {rnd('post_nir', 6)} AS postfire_nir_mean,
          {rnd('post_swir2', 6)} AS postfire_swir2_mean, {rnd('pre_nbr')} AS prefire_nbr, {rnd('post_nbr')} AS postfire_nbr,
          {rnd('pre_nbr - post_nbr')} AS dnbr FROM severity""",
        "severity",
    ),
)
def _(t: Tables) -> DataFrame:
    burned = composites.burn_date(t.keys, t.burns)
    out = composites.pre_post_composites(burned, t.sources["sentinel2_sr"])
    return rounded(out, 6, prefire_nbr=9, postfire_nbr=9, dnbr=9)


# --- labels and features ---------------------------------------------------


@query(
    "occurrence_labels",
    with_views(
        f"""SELECT patch_id, reference_date, {_COUNT_NAMES}, CAST(c7 > 0 AS INTEGER) AS y_occ_7d,
          CAST(c30 > 0 AS INTEGER) AS y_occ_30d, CAST(c60 > 0 AS INTEGER) AS y_occ_60d,
          reference_date + 1 AS label_window_start, reference_date + 60 AS label_window_end FROM counts""",
        "counts",
    ),
)
def occurrence_label_query(t: Tables) -> DataFrame:
    """Flagship: past counts and 7/30/60-day future labels for every patch and date."""
    counted = composites.past_future_event_counts(t.keys, t.sources["viirs_active_fire"], lookback_days=LOOKBACK)
    return labels.occurrence_labels(counted)


_PANEL_KEYS = ["patch_id", "reference_date"]


@query(
    "severity_labels",
    with_views(
        f"""SELECT patch_id, reference_date, y_occ_60d, {rnd('clipped')} AS y_sev_reg, y_sev_cls,
          CAST(clipped IS NOT NULL AS INTEGER) AS y_sev_available FROM labels_view""",
        "labels_view",
    ),
)
def _(t: Tables) -> DataFrame:
    counted = composites.past_future_event_counts(t.keys, t.sources["viirs_active_fire"], lookback_days=LOOKBACK)
    burned = composites.pre_post_composites(composites.burn_date(t.keys, t.burns), t.sources["sentinel2_sr"])
    labelled = labels.severity_labels(labels.occurrence_labels(counted.join(burned, _PANEL_KEYS, "left")))
    return rounded(labelled.select(*_PANEL_KEYS, "y_occ_60d", "y_sev_reg", "y_sev_cls", "y_sev_available"))


@query(
    "spectral_indices",
    with_views(
        f"""SELECT patch_id, reference_date, {rnd('ndvi')} AS optical_ndvi, {rnd('ndmi')} AS optical_ndmi,
          {rnd('evi')} AS optical_evi, {rnd('nbr')} AS optical_nbr_prefire,
          CAST(images > 0 AS INTEGER) AS optical_s2_signal_available FROM indices""",
        "indices",
    ),
)
def _(t: Tables) -> DataFrame:
    out = features.spectral_indices(
        composites.median_composite(t.keys, t.sources["sentinel2_sr"], b.BANDS, lookback_days=LOOKBACK)
    )
    names = ["optical_ndvi", "optical_ndmi", "optical_evi", "optical_nbr_prefire", "optical_s2_signal_available"]
    return rounded(out.select(*_PANEL_KEYS, *names))


def _rolling_sql(column: str, name: str) -> str:
    parts = []
    for n in (3, 7):
        w = f"OVER (PARTITION BY patch_id ORDER BY reference_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"{rnd(f'avg({column}) {w}', 8)} AS temporal_{name}_rmean_{n}")
        parts.append(f"{rnd(f'coalesce(stddev_samp({column}) {w}, 0)', 8)} AS temporal_{name}_rstd_{n}")
    return ", ".join(parts)


_ROLLING = {"ndvi": "optical_ndvi", "ndmi": "optical_ndmi", "nbr": "optical_nbr_prefire"}


@query(
    "rolling_stats",
    with_views(
        f"SELECT patch_id, reference_date, {', '.join(_rolling_sql(c, n) for c, n in _ROLLING.items())} FROM indices",
        "indices",
    ),
)
def _(t: Tables) -> DataFrame:
    indexed = features.spectral_indices(
        composites.median_composite(t.keys, t.sources["sentinel2_sr"], b.BANDS, lookback_days=LOOKBACK)
    )
    rolled = features.rolling_stats(indexed)
    return rounded(rolled.select(*_PANEL_KEYS, *[c for c in rolled.columns if c.startswith("temporal_")]), 8)


_SEQ_COLUMNS = ["weather_balance", "optical_price", "terrain_prio"]


@query(
    "sequences_pad",
    with_views(
        f"""SELECT patch_id, reference_date, CAST(k AS INTEGER) AS step, k < 4 - n AS pad,
          {', '.join(f'CAST(CASE WHEN k < 4 - n THEN 0 ELSE {c}[CAST(k - (4 - n) + 1 AS INTEGER)] END AS FLOAT) AS {c}' for c in _SEQ_COLUMNS)},
          y_occ, y_sev, y_sev_available
        FROM (SELECT patch_id, reference_date, count(*) OVER w AS n, {', '.join(f'list({c}) OVER w AS {c}' for c in _SEQ_COLUMNS)},
                CAST(y_occ_30d AS FLOAT) AS y_occ, CAST(coalesce(y_sev_reg, 0) AS FLOAT) AS y_sev,
                CAST(y_sev_available AS FLOAT) AS y_sev_available
              FROM (SELECT * REPLACE ({', '.join(f'CAST(coalesce({c}, (SELECT median({c}) FROM order_panel)) AS FLOAT) AS {c}' for c in _SEQ_COLUMNS)}) FROM order_panel)
              WINDOW w AS (PARTITION BY patch_id ORDER BY reference_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
             range(4) s(k)""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    made = features.build_sequences(t.order_panel, _SEQ_COLUMNS, seq_len=4)
    steps = made.select(
        *_PANEL_KEYS,
        F.posexplode(F.arrays_zip("x", "pad_mask")).alias("step", "item"),
        "y_occ",
        "y_sev",
        "y_sev_available",
    )
    return steps.select(
        *_PANEL_KEYS,
        "step",
        F.col("item.pad_mask").alias("pad"),
        *[F.col("item.x")[i].alias(c) for i, c in enumerate(_SEQ_COLUMNS)],
        "y_occ",
        "y_sev",
        "y_sev_available",
    )


@query(
    "ablate_family",
    with_views(
        """SELECT family, column_name, n_values FROM (
          SELECT 'optical' AS family, 'weather_balance' AS column_name, count(weather_balance) AS n_values FROM order_panel
          UNION ALL SELECT 'optical', 'terrain_prio', count(terrain_prio) FROM order_panel
          UNION ALL SELECT 'weather', 'optical_price', count(optical_price) FROM order_panel
          UNION ALL SELECT 'weather', 'terrain_prio', count(terrain_prio) FROM order_panel
          UNION ALL SELECT 'terrain', 'weather_balance', count(weather_balance) FROM order_panel
          UNION ALL SELECT 'terrain', 'optical_price', count(optical_price) FROM order_panel)""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    # per variant: its features and how many values each has
    variants = features.ablate_family(t.order_panel, ["optical_", "weather_", "terrain_"])
    out = []
    for family, df in variants.items():
        names = features.feature_columns(df)
        counts = df.agg(*[F.count(c).alias(c) for c in names])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in names])
        out.append(counts.select(F.lit(family).alias("family"), F.inline(pairs)))
    return metrics.comparison_table(out)


@query(
    "dependence_table",
    with_views(
        f"SELECT {rnd('weather_balance')} AS feature_value, y_occ_30d AS target_value FROM order_panel", "order_panel"
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(curves.dependence_table(t.order_panel, "weather_balance", "y_occ_30d"))


@query(
    "dependence_bins",
    with_views(
        f"""SELECT bin, count(*) AS n, {rnd('min(v)')} AS feature_min, {rnd('max(v)')} AS feature_max, {rnd('avg(y)')} AS target_mean
        FROM (SELECT weather_balance AS v, y_occ_30d AS y,
                CAST(floor((rank() OVER (ORDER BY weather_balance) - 1) * 20 / count(*) OVER ()) AS INTEGER) AS bin
              FROM order_panel WHERE weather_balance IS NOT NULL) GROUP BY bin""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(curves.dependence_bins(t.order_panel, "weather_balance", "y_occ_30d"))


# --- checks and summaries --------------------------------------------------


@query(
    "dataset_summary",
    with_views(
        f"""SELECT count(*) AS row_count, count(DISTINCT patch_id) AS unique_patches, min(reference_date) AS reference_date_min,
          max(reference_date) AS reference_date_max, {rnd('avg(y_occ_30d)')} AS positive_rate_y_occ_30d FROM order_panel""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(checks.dataset_summary(t.order_panel))


_PANEL_COLUMNS = [
    "patch_id", "reference_date", "reference_year", "weather_balance", "optical_price", "terrain_prio",
    "y_occ_7d", "y_occ_30d", "y_occ_60d", "y_sev_available", "y_sev_reg", "y_sev_cls",
]


def _missing_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {rnd(f'avg(CAST({c} IS NULL AS INTEGER))')} AS missing_rate FROM order_panel" for c in columns
    )


@query(
    "top_missing",
    with_views(f'SELECT * FROM ({_missing_sql(_PANEL_COLUMNS)}) ORDER BY missing_rate DESC, "column" LIMIT 20', "order_panel"),
)
def _(t: Tables) -> DataFrame:
    return rounded(checks.top_missing(t.order_panel))


@query(
    "label_missingness",
    with_views(
        _missing_sql(["y_occ_7d", "y_occ_30d", "y_occ_60d", "y_sev_reg", "y_sev_cls", "y_sev_available"]), "order_panel"
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(checks.label_missingness(t.order_panel))


@query(
    "duplicate_keys",
    with_views(
        "SELECT patch_id, reference_date, count(*) - 1 AS extra_rows FROM customer_orders GROUP BY ALL HAVING count(*) > 1",
        "customer_orders",
    ),
)
def _(t: Tables) -> DataFrame:
    return checks.duplicate_keys(t.customer_orders)


_SHIPPED = """(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS reference_date, max(CAST(l_shipdate AS DATE)) AS last_ship,
    min(CAST(l_shipdate AS DATE)) AS first_ship FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def _shipped(t: Tables) -> DataFrame:
    """Orders with the first and last ship day of their items."""
    ships = t.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.col("l_shipdate").cast("date")).alias("last_ship"), F.min(F.col("l_shipdate").cast("date")).alias("first_ship")
    )
    return (
        t.table("orders")
        .select("o_orderkey", F.col("o_orderdate").cast("date").alias("reference_date"))
        .join(ships, "o_orderkey")
    )


@query(
    "leakage_violations",
    f"""SELECT o_orderkey, reference_date, last_ship AS feature_max_timestamp FROM {_SHIPPED} WHERE last_ship > reference_date""",
)
def _(t: Tables) -> DataFrame:
    panel = _shipped(t).drop("first_ship").withColumnRenamed("last_ship", "feature_max_timestamp")
    return checks.leakage_violations(panel)


@query(
    "label_order_violations",
    f"""SELECT o_orderkey, reference_date, first_ship AS label_window_start FROM {_SHIPPED} WHERE first_ship <= reference_date""",
)
def _(t: Tables) -> DataFrame:
    panel = _shipped(t).drop("last_ship").withColumnRenamed("first_ship", "label_window_start")
    return checks.label_order_violations(panel)


@query(
    "severity_mask_violations",
    with_views(
        f"""SELECT patch_id, reference_date, {rnd('y')} AS y_sev_reg FROM
          (SELECT patch_id, reference_date, prio, CASE WHEN status = 'F' THEN price END AS y FROM unique_orders)
        WHERE prio > 3 AND y IS NOT NULL""",
        "unique_orders",
    ),
)
def _(t: Tables) -> DataFrame:
    panel = t.unique_orders.select(
        *_PANEL_KEYS,
        (F.col("prio") <= 3).cast("int").alias("y_sev_available"),
        F.when(F.col("status") == "F", F.col("price")).alias("y_sev_reg"),
        F.lit(None).cast("int").alias("y_sev_cls"),
    )
    return rounded(checks.severity_mask_violations(panel).select(*_PANEL_KEYS, "y_sev_reg"))


@query(
    "pending_keys",
    with_views(
        "SELECT patch_id, reference_date FROM spine ANTI JOIN (SELECT DISTINCT patch_id AS p, obs_date FROM obs) o ON patch_id = p AND reference_date = obs_date",
        "spine",
        "obs",
    ),
)
def _(t: Tables) -> DataFrame:
    done = t.observations.select("patch_id", F.col("obs_date").alias("reference_date"))
    return pending_keys(t.keys, done)


# --- splits and holdout ----------------------------------------------------


@query(
    "temporal_split",
    with_views(
        f"SELECT patch_id, reference_date, {SPLIT_SQL} AS split FROM order_panel WHERE reference_date <= DATE '{b.TEST_END}'",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return splits.temporal_split(t.order_panel.select(*_PANEL_KEYS), **SPLIT_ENDS)


_PREFIXES = ["cust_1_", "cust_24_"]
_PREFIX_SQL = "(starts_with(patch_id, 'cust_1_') OR starts_with(patch_id, 'cust_24_'))"


@query(
    "spatial_split",
    with_views(
        f"SELECT patch_id, reference_date, CASE WHEN {_PREFIX_SQL} THEN 'test' ELSE 'train' END AS spatial_split FROM order_panel",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return splits.spatial_split(t.order_panel.select(*_PANEL_KEYS), _PREFIXES)


@query(
    "date_range",
    with_views(
        "SELECT patch_id, reference_date, reference_year FROM order_panel WHERE reference_date BETWEEN DATE '1996-03-01' AND DATE '1999-10-31'",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return splits.date_range(t.order_panel.select(*_PANEL_KEYS, "reference_year"), "1996-03-01", "1999-10-31")


@query(
    "auto_holdout_prefixes",
    with_views(
        """SELECT 'cust_' || g || '_' AS prefix, g AS grid_row FROM (
          SELECT g, row_number() OVER (ORDER BY g DESC) AS rn, count(*) OVER () AS n FROM (
            SELECT DISTINCT CAST(split_part(patch_id, '_', 2) AS INTEGER) AS g FROM order_panel))
        WHERE rn <= greatest(1, floor(n * 0.25e0))""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return splits.auto_holdout_prefixes(t.order_panel)


_SCAN_SQL = f"""(SELECT w AS width, s.g AS row_start, e.g AS row_end, sum(r.n) AS n_rows, sum(r.pos) AS n_positive,
    sum(r.patches) AS n_patches, sum(r.sev) AS n_sev, string_agg('cust_' || r.g || '_', ' ' ORDER BY r.g) AS prefixes,
    max(s.total) AS total
  FROM rr s, range(1, 9) ww(w), rr e, rr r
  WHERE w <= greatest(1, floor(s.n_grid * 0.25e0)) AND e.idx = s.idx + w - 1 AND r.idx BETWEEN s.idx AND e.idx
  GROUP BY w, s.g, e.g)"""
_SCORED_SQL = f"""(SELECT *, n_positive * 1e0 / n_rows AS prevalence,
    3e0 * least(n_positive / 10e0, 3e0) + least(n_rows / 100e0, 2e0) + least(n_sev / 20e0, 1e0)
      + least(n_positive * 1e0 / n_rows / 0.1e0, 1e0) - abs(n_rows * 1e0 / total - 0.25e0) AS score,
    n_rows >= 100 AND n_positive >= 10 AND n_positive * 1e0 / n_rows >= 0.01e0 AS meets_criteria FROM {_SCAN_SQL})"""
_ROWS_SQL = """rr AS (SELECT *, row_number() OVER (ORDER BY g) AS idx, count(*) OVER () AS n_grid, sum(n) OVER () AS total FROM (
    SELECT CAST(split_part(patch_id, '_', 2) AS INTEGER) AS g, count(*) AS n, sum(y_occ_30d) AS pos,
      sum(y_sev_available) AS sev, count(DISTINCT patch_id) AS patches FROM order_panel GROUP BY 1))"""
_RANKED_SQL = f"""SELECT prefixes, width, row_start, row_end, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_patches AS BIGINT) AS n_patches,
    CAST(n_positive AS BIGINT) AS n_positive, {rnd('prevalence')} AS prevalence,
    CAST(n_sev AS BIGINT) AS n_severity_available, {rnd('n_sev * 1e0 / n_rows')} AS severity_available_rate, meets_criteria,
    {rnd('score')} AS score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT * REPLACE (CAST(width AS INTEGER) AS width), row_number() OVER (ORDER BY meets_criteria DESC, score DESC, n_positive DESC, n_rows DESC, width, row_start) AS rank
      FROM {_SCORED_SQL})"""


@query("scan_bands", with_views("", "order_panel").rstrip() + ",\n" + _ROWS_SQL + "\n" + _RANKED_SQL)
def _(t: Tables) -> DataFrame:
    return rounded(holdout.scan_bands(t.order_panel))


@query("best_band", with_views("", "order_panel").rstrip() + ",\n" + _ROWS_SQL + "\n" + _RANKED_SQL + " WHERE rank = 1")
def _(t: Tables) -> DataFrame:
    return rounded(holdout.best_band(t.order_panel))


_TEST_ROWS = f"FROM order_panel WHERE reference_date > DATE '{b.VAL_END}' AND reference_date <= DATE '{b.TEST_END}'"


@query(
    "auto_holdout",
    with_views("", "order_panel").rstrip()
    + ",\n"
    + _ROWS_SQL.replace("FROM order_panel", _TEST_ROWS)
    + f"""\nSELECT CASE WHEN p.g IS NOT NULL THEN 'test' ELSE 'train' END AS spatial_split, count(*) AS n_rows
      FROM order_panel o LEFT JOIN (SELECT row_start, row_end FROM ({_RANKED_SQL}) WHERE rank = 1) best
        ON CAST(split_part(o.patch_id, '_', 2) AS INTEGER) BETWEEN row_start AND row_end
      LEFT JOIN rr p ON p.g = CAST(split_part(o.patch_id, '_', 2) AS INTEGER) AND row_start IS NOT NULL GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    prefixes = holdout.auto_holdout(t.order_panel, **SPLIT_ENDS)
    return splits.spatial_split(t.order_panel, prefixes).groupBy("spatial_split").agg(F.count("*").alias("n_rows"))


@query(
    "severity_gate",
    with_views(
        f"""SELECT split, n_rows, n_severity, n_classes, CASE WHEN n_severity = 0 AND split <> 'test' THEN 'skip'
          WHEN n_classes < 2 AND split = 'train' THEN 'skip' WHEN n_classes < 2 AND split = 'test' THEN 'warn' ELSE 'ok' END AS verdict
        FROM (SELECT {SPLIT_SQL} AS split, count(*) AS n_rows, count(*) FILTER (WHERE y_sev_available = 1) AS n_severity,
                count(DISTINCT y_sev_cls) FILTER (WHERE y_sev_available = 1) AS n_classes
              FROM order_panel WHERE reference_date <= DATE '{b.TEST_END}' GROUP BY 1)""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return splits.severity_gate(splits.temporal_split(t.order_panel, **SPLIT_ENDS))


@query(
    "class_weights",
    with_views(
        f"""SELECT split, n_pos, n - n_pos AS n_neg, {rnd('(n - n_pos) * 1e0 / n_pos')} AS pos_weight
        FROM (SELECT {SPLIT_SQL} AS split, count(*) AS n, count(*) FILTER (WHERE y_occ_30d = 1) AS n_pos
              FROM order_panel WHERE reference_date <= DATE '{b.TEST_END}' GROUP BY 1)""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    panel = splits.temporal_split(t.order_panel, **SPLIT_ENDS)
    return rounded(splits.class_weights(panel, "y_occ_30d", by=["split"]))


@query(
    "class_distribution",
    with_views(
        f"""SELECT {SPLIT_SQL} AS split, y_sev_cls, count(*) AS "count" FROM order_panel
        WHERE y_sev_available = 1 AND reference_date <= DATE '{b.TEST_END}' GROUP BY ALL""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    panel = splits.severity_rows(splits.temporal_split(t.order_panel, **SPLIT_ENDS))
    return checks.class_distribution(panel, "y_sev_cls", by=["split"])


@query(
    "split_diagnostics",
    with_views(
        f"""SELECT {SPLIT_SQL} AS split, count(*) AS n_rows, 3 AS n_features, {rnd('avg(y_occ_30d)')} AS positive_rate,
          {rnd('(avg(CAST(weather_balance IS NULL AS INTEGER)) + avg(CAST(optical_price IS NULL AS INTEGER)) + avg(CAST(terrain_prio IS NULL AS INTEGER))) / 3')} AS feature_nan_rate
        FROM order_panel WHERE reference_date <= DATE '{b.TEST_END}' GROUP BY 1""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(splits.split_diagnostics(splits.temporal_split(t.order_panel, **SPLIT_ENDS)))


# --- metrics ---------------------------------------------------------------

_RANK_AUC = """SELECT model, score, (sum(rk) FILTER (WHERE y_true = 1) - p * (p + 1) / 2e0) / (p * n) AS roc_auc
  FROM (SELECT *, rank() OVER (PARTITION BY model, score ORDER BY y_score)
            + (count(*) OVER (PARTITION BY model, score, y_score) - 1) / 2e0 AS rk,
          CAST(sum(y_true) OVER (PARTITION BY model, score) AS DOUBLE) AS p,
          CAST(sum(1 - y_true) OVER (PARTITION BY model, score) AS DOUBLE) AS n FROM scores)
  GROUP BY model, score, p, n"""
_AP = """SELECT model, score, sum(pos / n_pos * tp / (tp + fp)) AS pr_auc,
    sum(pos / n_pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2) AS pr_trapezoid
  FROM ladder GROUP BY model, score"""
_EDGES = f"(VALUES {_literals(uniform_edges(10)[:-1])}) AS l(bin, bin_left)"
_BINS = f"""(SELECT s.model, s.score, l.bin, avg(y_score) AS mean_prediction, avg(y_true) AS observed_frequency, count(*) AS n
  FROM scores s JOIN (SELECT l.bin, l.bin_left, r.bin_right FROM {_EDGES}
    JOIN (VALUES {_literals(uniform_edges(10)[1:])}) AS r(bin, bin_right) ON l.bin = r.bin) l
    ON y_score >= bin_left AND y_score < bin_right GROUP BY s.model, s.score, l.bin)"""
_ECE = f"""SELECT model, score, sum(abs(mean_prediction - observed_frequency) * n) / max(total) AS ece
  FROM {_BINS} JOIN (SELECT model, score, count(*) AS total FROM scores GROUP BY ALL) USING (model, score) GROUP BY model, score"""
_BEST = """SELECT model, score, y_score AS best_threshold, f1 AS best_f1 FROM (
    SELECT *, row_number() OVER (PARTITION BY model, score ORDER BY f1 DESC, y_score ASC) AS rn
    FROM (SELECT *, 2 * tp / (tp + fp + n_pos) AS f1 FROM ladder)) WHERE rn = 1"""
_TOP = """SELECT model, {cols} FROM (SELECT model, y_true, row_number() OVER (PARTITION BY model ORDER BY y_prob DESC, md5(patch_id || '|' || reference_date)) AS rn,
    CAST(sum(y_true) OVER (PARTITION BY model) AS DOUBLE) AS p FROM occurrence) GROUP BY model"""


def _top_sql(ks: tuple[int, ...]) -> str:
    return _TOP.format(cols=", ".join(f"coalesce(sum(y_true) FILTER (WHERE rn <= {k}), 0) / max(p) AS topk_recall_{k}" for k in ks))


@query("roc_auc", with_views(f"SELECT model, score, {rnd('roc_auc')} AS roc_auc FROM ({_RANK_AUC})", "scores"))
def _(t: Tables) -> DataFrame:
    return rounded(metrics.roc_auc(t.occurrence))


@query(
    "average_precision",
    with_views(f"SELECT model, score, {rnd('pr_auc')} AS pr_auc, {rnd('pr_trapezoid')} AS pr_trapezoid FROM ({_AP})", "ladder"),
)
def _(t: Tables) -> DataFrame:
    return rounded(metrics.average_precision(t.occurrence))


@query("ece", with_views(f"SELECT model, score, {rnd('ece')} AS ece FROM ({_ECE})", "scores"))
def _(t: Tables) -> DataFrame:
    return rounded(metrics.ece(t.occurrence))


@query(
    "best_f1_threshold",
    with_views(f"SELECT model, score, {rnd('best_threshold')} AS best_threshold, {rnd('best_f1')} AS best_f1 FROM ({_BEST})", "ladder"),
)
def _(t: Tables) -> DataFrame:
    return rounded(metrics.best_f1_threshold(t.occurrence))


@query(
    "topk_recall",
    with_views(
        f"SELECT model, (SELECT count(*) FROM unique_orders) AS n, {', '.join(f'{rnd(f'topk_recall_{k}')} AS topk_recall_{k}' for k in (10, 100, 1000000))} FROM ({_top_sql((10, 100, 1000000))})",
        "occurrence",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(metrics.topk_recall(t.occurrence, (10, 100, 1_000_000)))


def _f1_sql(guess: str) -> str:
    return f"2e0 * count(*) FILTER (WHERE y_true = 1 AND {guess}) / (count(*) FILTER (WHERE {guess}) + sum(y_true))"


def _report_sql(rows: str = "occurrence", ks: tuple[int, ...] = (100, 500), prefix: str = "") -> str:
    """Occurrence report over the views; ``rows`` is the table it is for."""
    figures = {
        "f1": "b.f1",
        "roc_auc": "ra.roc_auc",
        "pr_auc": "ap.pr_auc",
        "ece_raw": "er.ece",
        "prevalence": "b.prevalence",
        "optimal_threshold": "fr.best_threshold",
        "optimal_f1": "fr.best_f1",
        "oracle_threshold_raw": "fr.best_threshold",
        "oracle_f1_raw": "fr.best_f1",
        "ece_calibrated": "ec.ece",
        "f1_calibrated": "b.f1_cal",
        "roc_auc_calibrated": "rc.roc_auc",
        "oracle_threshold_calibrated": "fc.best_threshold",
        "oracle_f1_calibrated": "fc.best_f1",
        "deployment_threshold": "b.threshold",
        "f1_calibrated_deployment": "b.f1_dep",
    }
    figures |= {f"topk_recall_{k}": f"CASE WHEN b.n >= {k} THEN tk.topk_recall_{k} END" for k in ks}
    select = ", ".join(f"{rnd(v)} AS {prefix}{k}" for k, v in figures.items())
    return f"""SELECT b.model, 'occurrence' AS {prefix}task, b.n AS {prefix}n_samples, {select}
      FROM (SELECT model, count(*) AS n, avg(y_true) AS prevalence, max(occurrence_decision_threshold) AS threshold,
              {_f1_sql('y_pred = 1')} AS f1, {_f1_sql('y_prob_calibrated >= 0.5e0')} AS f1_cal,
              {_f1_sql('y_prob_calibrated >= occurrence_decision_threshold')} AS f1_dep FROM {rows} GROUP BY model) b
      JOIN ({_RANK_AUC}) ra ON ra.model = b.model AND ra.score = 'raw'
      JOIN ({_RANK_AUC}) rc ON rc.model = b.model AND rc.score = 'calibrated'
      JOIN ({_AP}) ap ON ap.model = b.model AND ap.score = 'raw'
      JOIN ({_ECE}) er ON er.model = b.model AND er.score = 'raw'
      JOIN ({_ECE}) ec ON ec.model = b.model AND ec.score = 'calibrated'
      JOIN ({_BEST}) fr ON fr.model = b.model AND fr.score = 'raw'
      JOIN ({_BEST}) fc ON fc.model = b.model AND fc.score = 'calibrated'
      JOIN ({_top_sql(ks)}) tk ON tk.model = b.model"""


@query("evaluate_occurrence", with_views(_report_sql(), "ladder"))
def _(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate_occurrence(t.occurrence))


@query(
    "spatial_subset_metrics",
    with_views(_report_sql(prefix="spatial_").replace("SELECT b.model,", "SELECT b.model, b.n AS spatial_holdout_n,", 1), "ladder").replace(
        "FROM unique_orders),", f"FROM unique_orders WHERE {_PREFIX_SQL}),", 1
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(metrics.spatial_subset_metrics(t.occurrence, _PREFIXES, "occurrence"))


_CLASSES = """(SELECT c.model, c.class, sum(CAST(y_true = c.class AND y_pred = c.class AS INTEGER)) AS tp,
    sum(CAST(y_pred = c.class AS INTEGER)) AS predicted, sum(CAST(y_true = c.class AS INTEGER)) AS support
  FROM severity_cls s JOIN (SELECT model, y_true AS class FROM severity_cls UNION SELECT model, y_pred FROM severity_cls) c
    ON s.model = c.model GROUP BY c.model, c.class)"""
_CLASS_FIGURES = """(SELECT *, coalesce(tp * 1e0 / nullif(predicted, 0), 0) AS p, coalesce(tp * 1e0 / nullif(support, 0), 0) AS r,
    coalesce(2e0 * tp / nullif(predicted + support, 0), 0) AS f1 FROM """ + _CLASSES + ")"


@query(
    "evaluate_severity_cls",
    with_views(
        f"""SELECT model, "class", {rnd('p')} AS "precision", {rnd('r')} AS recall, {rnd('f1')} AS f1, CAST(support AS BIGINT) AS support
        FROM {_CLASS_FIGURES}""",
        "severity_cls",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate_severity_cls(t.severity_cls))


_CLS_ROW_SQL = f"""SELECT model, 'severity_cls' AS task, {rnd('avg(f1)')} AS sev_macro_f1, CAST(sum(support) AS BIGINT) AS n_samples,
  {', '.join(f'''{rnd(f'max(CASE WHEN "class" = {c} THEN p END)')} AS class_{c}_precision,
  {rnd(f'max(CASE WHEN "class" = {c} THEN r END)')} AS class_{c}_recall,
  CAST(max(CASE WHEN "class" = {c} THEN support END) AS BIGINT) AS class_{c}_support''' for c in (0, 1, 2))}
  FROM {_CLASS_FIGURES} GROUP BY model"""


@query("severity_cls_summary", with_views(_CLS_ROW_SQL, "severity_cls"))
def _(t: Tables) -> DataFrame:
    return rounded(metrics.severity_cls_summary(t.severity_cls))


_REG_SQL = f"""SELECT model, 'severity_reg' AS task, {rnd('avg(abs(y_true - y_pred))')} AS sev_mae,
  {rnd('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))')} AS sev_rmse, count(*) AS n_samples, {rnd('avg(y_true)')} AS y_true_mean,
  {rnd('stddev_pop(y_true)')} AS y_true_std, {rnd('avg(y_pred)')} AS y_pred_mean, {rnd('stddev_pop(y_pred)')} AS y_pred_std,
  {rnd('CASE WHEN stddev_pop(y_pred) > 0 THEN corr(y_true, y_pred) ELSE 0 END')} AS correlation FROM severity_reg GROUP BY model"""


@query("evaluate_severity_reg", with_views(_REG_SQL, "severity_reg"))
def _(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate_severity_reg(t.severity_reg))


_RISK = """(SELECT o.model AS occ_model, s.model AS sev_model, patch_id, reference_date, o.y_true, y_prob_calibrated * s.y_pred AS risk
  FROM occurrence o JOIN severity_reg s USING (patch_id, reference_date))"""


@query(
    "evaluate_combined_risk",
    with_views(
        f"""SELECT occ_model, sev_model, 'combined_risk' AS task, count(*) AS combined_risk_n, 'severity_available_intersection' AS combined_risk_subset, {rnd('avg(risk)')} AS expected_risk_mean,
          {rnd('stddev_pop(risk)')} AS expected_risk_std,
          {', '.join(f'''{rnd(f'CASE WHEN count(*) >= {k} THEN sum(y_true) FILTER (WHERE rn <= {k}) * 1e0 / sum(y_true) END')} AS combined_topk_recall_{k}''' for k in (100, 500))}
        FROM (SELECT *, row_number() OVER (PARTITION BY occ_model, sev_model ORDER BY risk DESC, md5(patch_id || '|' || reference_date)) AS rn FROM {_RISK})
        GROUP BY occ_model, sev_model""",
        "occurrence",
        "severity_reg",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate_combined_risk(t.occurrence, t.severity_reg))


@query(
    "comparison_table",
    with_views(f"SELECT * FROM ({_CLS_ROW_SQL}) UNION ALL BY NAME SELECT * FROM ({_REG_SQL})", "severity_cls", "severity_reg"),
)
def _(t: Tables) -> DataFrame:
    return rounded(
        metrics.comparison_table([metrics.severity_cls_summary(t.severity_cls), metrics.evaluate_severity_reg(t.severity_reg)])
    )


@query(
    "infer_task",
    with_views(
        """SELECT model, 'occurrence' AS task FROM occurrence GROUP BY model
        UNION ALL SELECT 'net_' || CAST(y_true % 2 AS VARCHAR), 'severity_cls' FROM severity_cls GROUP BY 1
        UNION ALL SELECT model, 'severity_reg' FROM severity_reg GROUP BY model""",
        "occurrence",
        "severity_cls",
        "severity_reg",
    ),
)
def _(t: Tables) -> DataFrame:
    # classifiers without a telling name are recognised by their few whole-number outputs
    unnamed = t.severity_cls.withColumn("model", F.concat(F.lit("net_"), F.col("y_true") % 2))
    everything = (
        t.occurrence.select("model", "y_prob", F.col("y_pred").cast("double"))
        .unionByName(unnamed.select("model", F.col("y_pred").cast("double")), allowMissingColumns=True)
        .unionByName(t.severity_reg.select("model", "y_pred"), allowMissingColumns=True)
    )
    return metrics.infer_task(everything)


_LOGITS = "(SELECT model, ln((y_prob + 0.01e0) / (1.01e0 - y_prob)) * 20 AS x, y_true AS y, y_prob_calibrated AS s, y_prob AS v, CAST(y_prob > 0.5e0 AS DOUBLE) AS m FROM occurrence)"


@query(
    "multitask_loss",
    with_views(
        f"""SELECT model, {rnd('o')} AS occurrence_loss, {rnd('s')} AS severity_loss, {rnd('o + 0.5e0 * s')} AS loss FROM (
          SELECT model, avg((1 - y) * x + (1 + 2e0 * y) * (ln(1 + exp(-abs(x))) + greatest(-x, 0e0))) AS o,
            sum(m * (s - v) * (s - v)) / (sum(m) + 1e-8) AS s FROM {_LOGITS} GROUP BY model)""",
        "occurrence",
    ),
)
def _(t: Tables) -> DataFrame:
    p = F.col("y_prob")
    outputs = t.occurrence.select(
        "model",
        (F.ln((p + 0.01) / (1.01 - p)) * 20).alias("logit"),
        F.col("y_true").alias("y_occ"),
        F.col("y_prob_calibrated").alias("sev_pred"),
        p.alias("y_sev"),
        (p > 0.5).cast("double").alias("mask"),
    )
    return rounded(metrics.multitask_loss(outputs, pos_weight=3.0, by=["model"]))


# --- curves ----------------------------------------------------------------


@query(
    "roc_curve",
    with_views(
        f"""SELECT r.model, r.score, 'roc' AS curve, {rnd('fp / n_neg')} AS x, {rnd('tp / n_pos')} AS y, threshold,
          {rnd('roc_auc')} AS metric FROM (
          SELECT model, score, fp, tp, n_pos, n_neg, y_score AS threshold FROM (
            SELECT *, row_number() OVER w AS rn, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM ladder
            WINDOW w AS (PARTITION BY model, score ORDER BY y_score DESC))
          WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg
          UNION ALL SELECT DISTINCT model, score, 0, 0, n_pos, n_neg, 'Infinity'::DOUBLE FROM ladder) r
        JOIN ({_RANK_AUC}) a ON a.model = r.model AND a.score = r.score""",
        "ladder",
    ),
)
def _(t: Tables) -> DataFrame:
    return _round_but(curves.roc_curve(t.occurrence), "threshold")


@query(
    "pr_curve",
    with_views(
        f"""SELECT l.model, l.score, 'precision_recall' AS curve, {rnd('x')} AS x, {rnd('y')} AS y, threshold, {rnd('pr_trapezoid')} AS metric FROM (
          SELECT model, score, tp / n_pos AS x, tp / (tp + fp) AS y, y_score AS threshold FROM ladder
          UNION ALL SELECT DISTINCT model, score, 0, 1, NULL FROM ladder) l
        JOIN ({_AP}) a ON a.model = l.model AND a.score = l.score""",
        "ladder",
    ),
)
def _(t: Tables) -> DataFrame:
    return _round_but(curves.pr_curve(t.occurrence), "threshold")


@query(
    "calibration_bins",
    with_views(
        f"""SELECT model, score, 'calibration' AS curve, e.bin_left, e.bin_right, {rnd('mean_prediction')} AS mean_prediction,
          {rnd('observed_frequency')} AS observed_frequency, n AS "count" FROM {_BINS} b JOIN (
            SELECT l.bin, l.bin_left, r.bin_right FROM {_EDGES} JOIN (VALUES {_literals(uniform_edges(10)[1:])}) AS r(bin, bin_right) ON l.bin = r.bin) e
          ON b.bin = e.bin""",
        "scores",
    ),
)
def _(t: Tables) -> DataFrame:
    return _round_but(curves.calibration_bins(t.occurrence), "bin_left", "bin_right")


@query(
    "reliability_histogram",
    with_views(
        f"""SELECT g.model, g.score, e.bin, {rnd('coalesce(mean_prediction, (bin_left + bin_right) / 2)')} AS bin_center,
          {rnd('coalesce(observed_frequency, 0)')} AS bin_rate, coalesce(n, 0) AS "count"
        FROM (SELECT DISTINCT model, score FROM scores) g,
             (SELECT l.bin, l.bin_left, r.bin_right FROM {_EDGES} JOIN (VALUES {_literals(uniform_edges(10)[1:])}) AS r(bin, bin_right) ON l.bin = r.bin) e
        LEFT JOIN {_BINS} b ON b.model = g.model AND b.score = g.score AND b.bin = e.bin""",
        "scores",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(curves.reliability_histogram(t.occurrence))


@query(
    "threshold_tradeoff",
    with_views(
        f"""SELECT model, score, threshold, {rnd('p')} AS "precision", {rnd('r')} AS recall, alerts,
          {rnd('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f1 FROM (
            SELECT model, score, threshold, count(*) FILTER (WHERE y_score >= threshold) AS alerts,
              coalesce(sum(y_true) FILTER (WHERE y_score >= threshold) * 1e0 / nullif(count(*) FILTER (WHERE y_score >= threshold), 0), 0) AS p,
              coalesce(sum(y_true) FILTER (WHERE y_score >= threshold) * 1e0 / nullif(sum(y_true), 0), 0) AS r
            FROM scores, (VALUES {_literals(curves.tradeoff_thresholds())}) AS th(i, threshold) GROUP BY model, score, threshold)""",
        "scores",
    ),
)
def _(t: Tables) -> DataFrame:
    return _round_but(curves.threshold_tradeoff(t.occurrence), "threshold")


@query(
    "cumulative_gain",
    with_views(
        f"""SELECT model, score, 'cumulative_gain' AS curve, CAST(rn AS BIGINT) AS "rank", {rnd('rn * 1e0 / n')} AS fraction_reviewed,
          {rnd('c * 1e0 / p')} AS fire_capture_rate FROM (
          SELECT model, score, row_number() OVER w AS rn, sum(y_true) OVER w AS c,
            count(*) OVER (PARTITION BY model, score) AS n, sum(y_true) OVER (PARTITION BY model, score) AS p FROM scores
          WINDOW w AS (PARTITION BY model, score ORDER BY y_score DESC, md5(patch_id || '|' || reference_date)
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        "scores",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(curves.cumulative_gain(t.occurrence))


@query(
    "residuals",
    with_views(
        f"SELECT model, patch_id, reference_date, {rnd('y_true')} AS y_true, {rnd('y_pred')} AS y_pred, {rnd('y_pred - y_true')} AS residual FROM severity_reg",
        "severity_reg",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(curves.residuals(t.severity_reg))


def _spatial_sql(name: str, out: str) -> str:
    """A severity report on the rows of the prefixes, its columns prefixed."""
    sql = ORACLES[name].replace("FROM unique_orders WHERE prio <= 3", f"FROM unique_orders WHERE prio <= 3 AND {_PREFIX_SQL}")
    sql = sql.replace("AS m(model) WHERE prio <= 3", f"AS m(model) WHERE prio <= 3 AND {_PREFIX_SQL}")
    return f"(SELECT model, COLUMNS(* EXCLUDE (model)) AS 'spatial_\\0', n_samples AS spatial_holdout_n FROM ({sql})) {out}"


_EVERY_REPORT = f"""SELECT * FROM ({ORACLES['evaluate_occurrence']}) LEFT JOIN ({ORACLES['spatial_subset_metrics']}) o USING (model)
UNION ALL BY NAME SELECT * FROM ({ORACLES['severity_cls_summary']}) LEFT JOIN {_spatial_sql('severity_cls_summary', 'c')} USING (model)
UNION ALL BY NAME SELECT * FROM ({ORACLES['evaluate_severity_reg']}) LEFT JOIN {_spatial_sql('evaluate_severity_reg', 'r')} USING (model)
UNION ALL BY NAME SELECT 'risk__' || occ_model || '+' || sev_model AS model, * EXCLUDE (occ_model, sev_model) FROM ({ORACLES['evaluate_combined_risk']})"""


@query("evaluate_all", _EVERY_REPORT)
def _(t: Tables) -> DataFrame:
    everything = (
        t.occurrence.withColumn("y_true", F.col("y_true").cast("double"))
        .withColumn("y_pred", F.col("y_pred").cast("double"))
        .unionByName(t.severity_cls.withColumns({c: F.col(c).cast("double") for c in ("y_true", "y_pred")}), allowMissingColumns=True)
        .unionByName(t.severity_reg, allowMissingColumns=True)
    )
    return rounded(evaluate_all(everything, prefixes=_PREFIXES))


@query(
    "research_curves",
    with_views(
        """SELECT "table", CAST(n AS BIGINT) AS n_rows FROM (
          SELECT 'calibration_bins' AS "table", count(*) AS n FROM """
        + _BINS
        + """ UNION ALL SELECT 'threshold_tradeoffs', 99 * count(*) FROM (SELECT DISTINCT model, score FROM scores)
          UNION ALL SELECT 'cumulative_gain', count(*) FROM scores
          UNION ALL SELECT 'severity_regression_diagnostics', count(*) FROM severity_reg
          UNION ALL SELECT 'roc_pr_curve_points', (SELECT count(*) FROM ladder) + 2 * (SELECT count(*) FROM (SELECT DISTINCT model, score FROM ladder))
            + count(*) FROM (SELECT row_number() OVER w AS rn, pos, neg, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM ladder
                WINDOW w AS (PARTITION BY model, score ORDER BY y_score DESC)) WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg)""",
        "ladder",
        "severity_reg",
    ),
)
def _(t: Tables) -> DataFrame:
    sizes = [
        df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
        for name, df in research_curves(t.occurrence, t.severity_reg).items()
    ]
    return metrics.comparison_table(sizes)


# --- risk, quantiles, samples ----------------------------------------------

_RISK_ROWS = """(SELECT patch_id, reference_date, least(floor(price / 50e0) / 10000e0, 1e0) AS p,
    greatest((custkey % 1000 - 100) / 1000e0, 0e0) AS s FROM unique_orders)"""


def _risk_rows(t: Tables) -> DataFrame:
    fire = t.unique_orders.select(*_PANEL_KEYS, F.least(F.floor(F.col("price") / 50) / 10000, F.lit(1.0)).alias("p_fire"))
    severity = t.unique_orders.select(*_PANEL_KEYS, ((F.col("custkey") % 1000 - 100) / 1000).alias("severity_conditional"))
    return metrics.prediction_table(t.unique_orders, fire, severity, threshold=0.35)


@query(
    "prediction_table",
    with_views(
        f"""SELECT patch_id, reference_date, {rnd('p')} AS p_fire, {rnd('s')} AS severity_conditional, {rnd('p * s')} AS expected_risk,
          CAST(p >= 0.35e0 AS INTEGER) AS fire_alert, 0.35e0 AS fire_alert_threshold FROM {_RISK_ROWS}""",
        "unique_orders",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(_risk_rows(t))


@query(
    "inference_summary",
    with_views(
        f"""SELECT count(*) AS n, {rnd('avg(p)')} AS p_fire_mean, {rnd('stddev_samp(p)')} AS p_fire_std,
          {rnd('avg(s)')} AS severity_conditional_mean, {rnd('stddev_samp(s)')} AS severity_conditional_std,
          {rnd('avg(p * s)')} AS expected_risk_mean, {rnd('stddev_samp(p * s)')} AS expected_risk_std,
          CAST(sum(CAST(p >= 0.35e0 AS INTEGER)) AS BIGINT) AS n_alerts, {rnd('avg(CAST(p >= 0.35e0 AS INTEGER))')} AS alert_share
        FROM {_RISK_ROWS}""",
        "unique_orders",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(metrics.inference_summary(_risk_rows(t)))


@query(
    "expected_risk",
    with_views(
        f"SELECT occ_model, sev_model, patch_id, reference_date, {rnd('risk')} AS expected_risk FROM {_RISK}", "occurrence", "severity_reg"
    ),
)
def _(t: Tables) -> DataFrame:
    pairs = metrics.risk_pairs(t.occurrence, t.severity_reg)
    return rounded(pairs.select("occ_model", "sev_model", *_PANEL_KEYS, "expected_risk"))


@query(
    "exact_quantiles",
    with_views(
        " UNION ALL ".join(
            f"SELECT {SPLIT_SQL} AS split, '{c}' AS feature, {p}::DOUBLE AS prob, {rnd(f'quantile_cont({c}, {p})', 6)} AS quantile FROM order_panel WHERE reference_date <= DATE '{b.TEST_END}' GROUP BY 1"
            for c in _SEQ_COLUMNS
            for p in (0.01, 0.5, 0.99)
        ),
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    panel = splits.temporal_split(t.order_panel, **SPLIT_ENDS)
    return _round_but(ordered.exact_quantiles(panel, _SEQ_COLUMNS, [0.01, 0.5, 0.99], by=["split"]), "prob").withColumn(
        "quantile", F.round("quantile", 6) + F.lit(0.0)
    )


_SEVERITY_COLUMNS = {
    "prefire_nir_mean": "pre_nir", "prefire_swir2_mean": "pre_swir2", "postfire_nir_mean": "post_nir", "postfire_swir2_mean": "post_swir2",
    "prefire_nbr": "pre_nbr", "postfire_nbr": "post_nbr", "dnbr": "pre_nbr - post_nbr",
}
_INDEX_COLUMNS = {"optical_ndvi": "ndvi", "optical_ndmi": "ndmi", "optical_evi": "evi", "optical_nbr_prefire": "nbr"}


@query(
    "panel_build",
    with_views(
        f"""SELECT l.patch_id, l.reference_date, CAST(year(l.reference_date) AS INTEGER) AS reference_year,
          CAST(coalesce(greatest(l.seen, w.seen), l.reference_date) AS DATE) AS feature_max_date, {_COUNT_NAMES},
          l.images AS optical_s2_observation_count, {', '.join(f'{rnd(f"o.{x}", 6)} AS optical_{x}_mean_l{LOOKBACK}d' for x in b.BANDS)},
          {', '.join(f'{rnd(f"i.{v}", 8)} AS {k}' for k, v in _INDEX_COLUMNS.items())}, CAST(i.images > 0 AS INTEGER) AS optical_s2_signal_available,
          r.* EXCLUDE (patch_id, reference_date), {', '.join(f'{rnd(v, 6)} AS {k}' for k, v in _SEVERITY_COLUMNS.items())}, burn_date,
          w.images AS weather_era5_obs_count, {rnd('w.mean', 6)} AS weather_temperature_2m_mean_l{LOOKBACK}d,
          {rnd('w.rain', 6)} AS weather_total_precipitation_sum_mean_l{LOOKBACK}d,
          {rnd('p.elevation', 6)} AS terrain_elevation_mean, y_occ_7d, y_occ_30d, y_occ_60d, {rnd('clipped', 6)} AS y_sev_reg, y_sev_cls,
          CAST(clipped IS NOT NULL AS INTEGER) AS y_sev_available
        FROM labels_view l JOIN indices i USING (patch_id, reference_date) JOIN patches p USING (patch_id)
        LEFT JOIN optical o USING (patch_id, reference_date)
        JOIN (SELECT patch_id, reference_date, {', '.join(_rolling_sql(c, n) for c, n in _ROLLING.items())} FROM indices) r USING (patch_id, reference_date)
        JOIN cell_weather w ON w.cell = p.cell AND w.reference_date = l.reference_date""",
        "labels_view",
        "indices",
        "optical",
        "cell_weather",
    ),
)
def panel_query(t: Tables) -> DataFrame:
    """The whole panel build, all sources to labels and features, with every column it makes."""
    panel = full_panel(t)
    rolled = {c: 8 for c in panel.columns if c.startswith("temporal_") and "_r" in c}
    chosen = panel.select(
        *_PANEL_KEYS, "reference_year", F.col("feature_max_timestamp").cast("date").alias("feature_max_date"),
        f"temporal_fire_past_count_l{LOOKBACK}d", *[f"viirs_future_fire_count_{h}d" for h in (7, 30, 60)], "optical_s2_observation_count",
        *[f"optical_{x}_mean_l{LOOKBACK}d" for x in b.BANDS], *_INDEX_COLUMNS, "optical_s2_signal_available", *rolled, *_SEVERITY_COLUMNS, "burn_date",
        "weather_era5_obs_count", *[f"weather_{v}_mean_l{LOOKBACK}d" for v in ("temperature_2m", "total_precipitation_sum")],
        "terrain_elevation_mean", "y_occ_7d", "y_occ_30d", "y_occ_60d", "y_sev_reg", "y_sev_cls", "y_sev_available",
    )
    return rounded(chosen, 6, **rolled, **{c: 8 for c in _INDEX_COLUMNS})


def full_panel(t: Tables) -> DataFrame:
    """The panel of all sources. Observations meet their patches once, not once for each use, and every summary of them is
    written before the next is made; what is left to do are joins of summaries."""
    seen = settled(t.observations, "observations")
    panel = build_panel(
        t.spine, t.sources_of(seen), lookback_days=LOOKBACK, bands=b.BANDS, weather_cell="cell", period=(b.START, b.END), keep=settled
    )
    discard(seen)
    return panel
