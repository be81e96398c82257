"""The given tables seen as patches, observations and predictions, and the same in SQL.

``Tables`` gives DataFrames; ``VIEWS`` holds the matching SQL views by name, with
``with_views`` putting the needed ones in front of a query.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import panel_spine

START, END, STEP = "1995-01-01", "2001-12-31", "28D"  # all dates the tables cover
LOOKBACK = 60
TRAIN_END, VAL_END, TEST_END = "1998-12-31", "2000-06-30", "2001-12-31"
EVENT_START, EVENT_END = "2024-01-01", "2024-01-30"
GRID_KM = 50
BOUNDS = (94.0, -11.0, 141.0, 6.5)
# Scale of measured values. With prices as they are, means fall on rounding ties
# (x.5 in the last kept digit), where any order of summing may win.
UNIT = 0.0271828182845905
BANDS = ["b2", "b3", "b4", "b8", "b11", "b12"]


class Tables:
    """Lazy bound inputs over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def patches(self) -> DataFrame:
        lon = F.lit(94.0) + F.col("s_suppkey") * F.lit(0.045)
        lat = F.lit(-11.0) + F.col("s_nationkey") * F.lit(0.045)
        return self.table("supplier").select(
            F.concat_ws("_", F.lit("sup"), "s_nationkey", "s_suppkey").alias("patch_id"),
            lon.alias("min_lon"),
            lat.alias("min_lat"),
            (lon + F.lit(0.045)).alias("max_lon"),
            (lat + F.lit(0.045)).alias("max_lat"),
            F.col("s_nationkey").alias("cell"),
        )

    @cached_property
    def spine(self) -> DataFrame:
        return panel_spine(self.patches, START, END, STEP)

    @cached_property
    def keys(self) -> DataFrame:
        return self.spine.select("patch_id", "reference_date")

    @cached_property
    def observations(self) -> DataFrame:
        places = self.table("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"),
            F.concat_ws("_", F.lit("sup"), "s_nationkey", "s_suppkey").alias("patch_id"),
        )
        fire = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
        return (
            self.table("lineitem")
            .join(places, "l_suppkey")
            .select(
                "patch_id",
                F.col("l_linenumber").alias("pixel_id"),
                F.col("l_orderkey").alias("image_id"),
                F.col("l_shipdate").cast("date").alias("obs_date"),
                (F.abs("l_discount") * 10000 * UNIT).alias("b2"),
                ((F.abs("l_discount") * 5000 + F.col("l_quantity") * 10) * UNIT).alias("b3"),
                (F.col("l_quantity") * 1000 * UNIT).alias("b4"),
                (F.col("l_extendedprice") * UNIT).alias("b8"),
                (F.abs("l_tax") * 100000 * UNIT).alias("b11"),
                ((51 - F.col("l_quantity")) * 1200 * UNIT).alias("b12"),
                F.when(fire, 9).otherwise(3).alias("fire_mask"),
            )
        )

    @cached_property
    def burns(self) -> DataFrame:
        return self._burns(self.observations)

    @staticmethod
    def _burns(observations: DataFrame) -> DataFrame:
        return observations.filter("fire_mask >= 7").select(
            "patch_id",
            F.trunc("obs_date", "month").alias("image_date"),
            F.dayofyear("obs_date").alias("burn_doy"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        owners = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        return (
            self.table("orders")
            .join(owners, "o_custkey")
            .select(
                F.col("c_nationkey").alias("cell"),
                F.col("o_custkey").alias("pixel_id"),
                F.col("o_orderkey").alias("image_id"),
                F.col("o_orderdate").cast("date").alias("obs_date"),
                (F.col("o_totalprice") * UNIT).alias("temperature_2m"),
                (F.col("o_orderkey") % 97 * UNIT).alias("total_precipitation_sum"),
            )
        )

    @cached_property
    def terrain(self) -> DataFrame:
        return self.table("supplier").select(
            F.concat_ws("_", F.lit("sup"), "s_nationkey", "s_suppkey").alias("patch_id"),
            F.col("s_acctbal").alias("elevation"),
        )

    @cached_property
    def sources(self) -> dict[str, DataFrame]:
        return self.sources_of(self.observations)

    def sources_of(self, observations: DataFrame) -> dict[str, DataFrame]:
        """All sources, those of observations from this form of ``observations``."""
        return {
            "viirs_active_fire": observations.select("patch_id", "obs_date", "fire_mask"),
            "sentinel2_sr": observations.select("patch_id", "pixel_id", "image_id", "obs_date", *BANDS),
            "era5_land_daily": self.weather,
            "srtm": self.terrain,
            "burn_severity": self._burns(observations),
        }

    @cached_property
    def points(self) -> DataFrame:
        return self.table("orders").select(
            "o_orderkey",
            (F.lit(94.0) + (F.col("o_totalprice") % 4700) / 100).alias("lon"),
            (F.lit(-11.0) + (F.col("o_custkey") * 37 % 1750) / 100).alias("lat"),
        )

    @cached_property
    def _owned_orders(self) -> DataFrame:
        """``customer_orders`` with the nation of the customer."""
        owners = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment"
        )
        return (
            self.table("orders")
            .join(owners, "o_custkey")
            .select(
                F.concat_ws("_", F.lit("cust"), "c_nationkey", "o_custkey").alias("patch_id"),
                "c_nationkey",
                F.col("o_orderdate").cast("date").alias("reference_date"),
                "o_orderkey",
                F.col("o_custkey").alias("custkey"),
                F.col("o_orderstatus").alias("status"),
                F.col("o_totalprice").alias("price"),
                F.substring("o_orderpriority", 1, 1).try_cast("int").alias("prio"),
                F.col("c_acctbal").alias("acctbal"),
                F.col("c_mktsegment").alias("segment"),
            )
        )

    @cached_property
    def customer_orders(self) -> DataFrame:
        """Orders keyed by customer patch and day, duplicates included."""
        return self._owned_orders.drop("c_nationkey")

    @cached_property
    def unique_orders(self) -> DataFrame:
        """The first order of each customer and day.

        Nation and key of a customer, which is never null, stand for the patch: numbers sort faster than names that begin alike.
        """
        values = ["custkey", "status", "price", "prio", "acctbal", "segment"]
        owner = [F.col("custkey").alias("_key"), F.col("c_nationkey").alias("_nation")]
        return (
            self._owned_orders.groupBy(*owner, "reference_date")
            .agg(F.min_by(F.struct(*values), "o_orderkey").alias("v"))
            .select(F.concat_ws("_", F.lit("cust"), "_nation", "_key").alias("patch_id"), "reference_date", "v.*")
        )

    @cached_property
    def order_panel(self) -> DataFrame:
        """A panel with labels and features over the unique orders."""
        available = F.col("prio") <= 3
        return self.unique_orders.select(
            "patch_id",
            "reference_date",
            F.year("reference_date").alias("reference_year"),
            F.when(F.col("segment") != "MACHINERY", F.col("acctbal")).alias("weather_balance"),
            F.col("price").alias("optical_price"),
            F.when(F.col("prio") != 5, F.col("prio").cast("double")).alias("terrain_prio"),
            (F.col("status") == "P").cast("int").alias("y_occ_7d"),
            (F.col("status") == "F").cast("int").alias("y_occ_30d"),
            (F.col("status") != "O").cast("int").alias("y_occ_60d"),
            available.cast("int").alias("y_sev_available"),
            F.when(available, F.floor(F.col("price") / 50) / 10000).alias("y_sev_reg"),
            F.when(available, F.col("prio") - 1).alias("y_sev_cls"),
        )

    @cached_property
    def occurrence(self) -> DataFrame:
        """Predictions of two models in long form, with a calibrated score."""
        prob = F.least(F.floor(F.col("price") / 50) / 10000, F.lit(1.0))
        base = self.unique_orders.select(
            "patch_id", "reference_date", (F.col("status") == "F").cast("int").alias("y_true"), prob.alias("p")
        )
        models = F.array(
            F.struct(F.lit("price").alias("model"), F.col("p").alias("y_prob")),
            F.struct(F.lit("inverse").alias("model"), (1.0 - F.col("p")).alias("y_prob")),
        )
        return base.select("patch_id", "reference_date", "y_true", F.inline(models)).select(
            "*",
            (F.floor((F.lit(0.1) + F.lit(0.8) * F.col("y_prob")) * 10000) / 10000).alias("y_prob_calibrated"),
            F.lit(0.35).alias("occurrence_decision_threshold"),
            (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"),
        )

    @property
    def _severity(self) -> DataFrame:
        return self.unique_orders.filter(F.col("prio") <= 3)

    @cached_property
    def severity_cls(self) -> DataFrame:
        return self._severity.select(
            F.lit("sev_cls_price").alias("model"),
            "patch_id",
            "reference_date",
            (F.col("prio") - 1).alias("y_true"),
            F.least(F.floor(F.col("price") / 170000), F.lit(2)).cast("int").alias("y_pred"),
        )

    @cached_property
    def severity_reg(self) -> DataFrame:
        models = F.array(
            F.struct(F.lit("sev_reg_key").alias("model"), ((F.col("custkey") % 1000) / 1000).alias("y_pred")),
            F.struct(F.lit("sev_reg_flat").alias("model"), F.lit(0.5).alias("y_pred")),
        )
        return self._severity.select(
            "patch_id",
            "reference_date",
            (F.floor(F.col("price") / 50) / 10000).alias("y_true"),
            F.inline(models),
        )

    @cached_property
    def event_fires(self) -> DataFrame:
        mask = F.when(F.col("event_type") == "error", 9).otherwise(3)
        return self.table("events").select(
            F.concat(F.lit("user_"), "user_id").alias("patch_id"),
            F.col("ts").cast("date").alias("obs_date"),
            mask.alias("fire_mask"),
        )


# ---------------------------------------------------------------------------
# The same inputs in SQL: name -> (views it needs, text)
# ---------------------------------------------------------------------------

VIEWS: dict[str, tuple[list[str], str]] = {
    "patches": (
        [],
        """SELECT s_suppkey, 'sup_' || s_nationkey || '_' || s_suppkey AS patch_id,
             94e0 + s_suppkey * 0.045e0 AS min_lon, -11e0 + s_nationkey * 0.045e0 AS min_lat,
             94e0 + s_suppkey * 0.045e0 + 0.045e0 AS max_lon, -11e0 + s_nationkey * 0.045e0 + 0.045e0 AS max_lat,
             s_nationkey AS cell, s_acctbal AS elevation
           FROM supplier""",
    ),
    "spine": (
        ["patches"],
        f"""SELECT p.*, CAST(d AS DATE) AS reference_date
           FROM patches p, generate_series(DATE '{START}', DATE '{END}', INTERVAL 28 DAY) AS t(d)""",
    ),
    "obs": (
        ["patches"],
        f"""SELECT p.patch_id, l_linenumber AS pixel_id, l_orderkey AS image_id, CAST(l_shipdate AS DATE) AS obs_date,
             abs(l_discount) * 10000 * {UNIT}e0 AS b2, (abs(l_discount) * 5000 + l_quantity * 10) * {UNIT}e0 AS b3,
             l_quantity * 1000 * {UNIT}e0 AS b4, l_extendedprice * {UNIT}e0 AS b8, abs(l_tax) * 100000 * {UNIT}e0 AS b11,
             (51 - l_quantity) * 1200 * {UNIT}e0 AS b12,
             CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 9 ELSE 3 END AS fire_mask
           FROM lineitem JOIN patches p ON l_suppkey = p.s_suppkey""",
    ),
    "burns": (
        ["obs"],
        """SELECT patch_id, CAST(date_trunc('month', obs_date) AS DATE) AS image_date, dayofyear(obs_date) AS burn_doy
           FROM obs WHERE fire_mask >= 7""",
    ),
    "weather": (
        [],
        f"""SELECT c_nationkey AS cell, o_custkey AS pixel_id, o_orderkey AS image_id,
             CAST(o_orderdate AS DATE) AS obs_date, o_totalprice * {UNIT}e0 AS temperature_2m,
             o_orderkey % 97 * {UNIT}e0 AS total_precipitation_sum
           FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "points": (
        [],
        """SELECT o_orderkey, 94e0 + (o_totalprice % 4700e0) / 100e0 AS lon,
             -11e0 + (o_custkey * 37 % 1750) / 100e0 AS lat FROM orders""",
    ),
    "customer_orders": (
        [],
        """SELECT 'cust_' || c_nationkey || '_' || c_custkey AS patch_id, CAST(o_orderdate AS DATE) AS reference_date,
             o_orderkey, c_custkey AS custkey, o_orderstatus AS status, o_totalprice AS price,
             TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio, c_acctbal AS acctbal, c_mktsegment AS segment
           FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
    "unique_orders": (
        ["customer_orders"],
        """SELECT * EXCLUDE (rn, o_orderkey) FROM (
             SELECT *, row_number() OVER (PARTITION BY patch_id, reference_date ORDER BY o_orderkey) AS rn
             FROM customer_orders) WHERE rn = 1""",
    ),
    "order_panel": (
        ["unique_orders"],
        """SELECT patch_id, reference_date, CAST(year(reference_date) AS INTEGER) AS reference_year,
             CASE WHEN segment <> 'MACHINERY' THEN acctbal END AS weather_balance, price AS optical_price,
             CASE WHEN prio <> 5 THEN CAST(prio AS DOUBLE) END AS terrain_prio,
             CAST(status = 'P' AS INTEGER) AS y_occ_7d, CAST(status = 'F' AS INTEGER) AS y_occ_30d,
             CAST(status <> 'O' AS INTEGER) AS y_occ_60d, CAST(prio <= 3 AS INTEGER) AS y_sev_available,
             CASE WHEN prio <= 3 THEN floor(price / 50e0) / 10000e0 END AS y_sev_reg,
             CASE WHEN prio <= 3 THEN prio - 1 END AS y_sev_cls
           FROM unique_orders""",
    ),
    "occurrence": (
        ["unique_orders"],
        """SELECT *, floor((0.1e0 + 0.8e0 * y_prob) * 10000) / 10000e0 AS y_prob_calibrated,
             0.35e0 AS occurrence_decision_threshold, CAST(y_prob >= 0.5e0 AS INTEGER) AS y_pred
           FROM (
             SELECT patch_id, reference_date, CAST(status = 'F' AS INTEGER) AS y_true, model,
               CASE model WHEN 'price' THEN p ELSE 1e0 - p END AS y_prob
             FROM (SELECT *, least(floor(price / 50e0) / 10000e0, 1e0) AS p FROM unique_orders),
                  (VALUES ('price'), ('inverse')) AS m(model))""",
    ),
    "scores": (
        ["occurrence"],
        """SELECT model, patch_id, reference_date, y_true, 'raw' AS score, y_prob AS y_score FROM occurrence
           UNION ALL
           SELECT model, patch_id, reference_date, y_true, 'calibrated', y_prob_calibrated FROM occurrence""",
    ),
    "ladder": (
        ["scores"],
        """SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
             CAST(sum(pos) OVER g AS DOUBLE) AS n_pos, CAST(sum(neg) OVER g AS DOUBLE) AS n_neg
           FROM (SELECT model, score, y_score, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg
                 FROM scores GROUP BY model, score, y_score)
           WINDOW w AS (PARTITION BY model, score ORDER BY y_score DESC),
                  g AS (PARTITION BY model, score)""",
    ),
    "severity_cls": (
        ["unique_orders"],
        """SELECT 'sev_cls_price' AS model, patch_id, reference_date, prio - 1 AS y_true,
             CAST(least(floor(price / 170000e0), 2) AS INTEGER) AS y_pred FROM unique_orders WHERE prio <= 3""",
    ),
    "severity_reg": (
        ["unique_orders"],
        """SELECT patch_id, reference_date, floor(price / 50e0) / 10000e0 AS y_true, model,
             CASE model WHEN 'sev_reg_key' THEN (custkey % 1000) / 1000e0 ELSE 0.5e0 END AS y_pred
           FROM unique_orders, (VALUES ('sev_reg_key'), ('sev_reg_flat')) AS m(model) WHERE prio <= 3""",
    ),
    "event_fires": (
        [],
        """SELECT 'user_' || user_id AS patch_id, CAST(ts AS DATE) AS obs_date,
             CASE WHEN event_type = 'error' THEN 9 ELSE 3 END AS fire_mask FROM events""",
    ),
    "counts": (
        ["spine", "obs"],
        """SELECT s.patch_id, s.reference_date,
             CAST(count(*) FILTER (WHERE fire_mask >= 7 AND obs_date <= reference_date) AS DOUBLE) AS past,
             CAST(count(*) FILTER (WHERE fire_mask >= 7 AND obs_date BETWEEN reference_date + 1 AND reference_date + 7) AS DOUBLE) AS c7,
             CAST(count(*) FILTER (WHERE fire_mask >= 7 AND obs_date BETWEEN reference_date + 1 AND reference_date + 30) AS DOUBLE) AS c30,
             CAST(count(*) FILTER (WHERE fire_mask >= 7 AND obs_date BETWEEN reference_date + 1 AND reference_date + 60) AS DOUBLE) AS c60,
             CAST(count(DISTINCT image_id) FILTER (WHERE obs_date <= reference_date) AS DOUBLE) AS images,
             max(obs_date) FILTER (WHERE obs_date <= reference_date) AS seen
           FROM spine s LEFT JOIN obs o
             ON s.patch_id = o.patch_id AND obs_date BETWEEN reference_date - 60 AND reference_date + 60
           GROUP BY s.patch_id, s.reference_date""",
    ),
    "optical": (
        ["spine", "obs"],
        """SELECT patch_id, reference_date, avg(b2) AS b2, avg(b3) AS b3, avg(b4) AS b4, avg(b8) AS b8,
             avg(b11) AS b11, avg(b12) AS b12
           FROM (SELECT s.patch_id, s.reference_date, pixel_id, median(b2) AS b2, median(b3) AS b3, median(b4) AS b4,
                   median(b8) AS b8, median(b11) AS b11, median(b12) AS b12
                 FROM spine s JOIN obs o
                   ON s.patch_id = o.patch_id AND obs_date BETWEEN reference_date - 60 AND reference_date
                 GROUP BY s.patch_id, s.reference_date, pixel_id)
           GROUP BY patch_id, reference_date""",
    ),
    "cell_weather": (
        ["spine", "weather"],
        """SELECT c.cell, c.reference_date, CAST(coalesce(max(n), 0) AS DOUBLE) AS images, avg(m) AS mean, avg(r) AS rain, max(seen) AS seen
           FROM (SELECT DISTINCT cell, reference_date FROM spine) c
           LEFT JOIN (SELECT c2.cell, c2.reference_date, pixel_id, avg(temperature_2m) AS m, avg(total_precipitation_sum) AS r, max(obs_date) AS seen
                 FROM (SELECT DISTINCT cell, reference_date FROM spine) c2 JOIN weather w
                   ON c2.cell = w.cell AND obs_date BETWEEN reference_date - 60 AND reference_date
                 GROUP BY c2.cell, c2.reference_date, pixel_id) px USING (cell, reference_date)
           LEFT JOIN (SELECT c3.cell, c3.reference_date, count(DISTINCT image_id) AS n
                 FROM (SELECT DISTINCT cell, reference_date FROM spine) c3 JOIN weather w
                   ON c3.cell = w.cell AND obs_date BETWEEN reference_date - 60 AND reference_date
                 GROUP BY c3.cell, c3.reference_date) im USING (cell, reference_date)
           GROUP BY c.cell, c.reference_date""",
    ),
    "burned": (
        ["spine", "burns"],
        """SELECT s.patch_id, s.reference_date,
             CASE WHEN max(burn_doy) > 0
               THEN make_date(CAST(year(s.reference_date + 1) AS INTEGER), 1, 1) + CAST(max(burn_doy) - 1 AS INTEGER) END AS burn_date
           FROM spine s LEFT JOIN burns b
             ON s.patch_id = b.patch_id AND image_date BETWEEN reference_date + 1 AND reference_date + 90
           GROUP BY s.patch_id, s.reference_date""",
    ),
    "phases": (
        ["burned", "obs"],
        """SELECT patch_id, burn_date, phase, avg(b8) AS nir, avg(b12) AS swir2
           FROM (SELECT a.patch_id, a.burn_date, pixel_id,
                   CASE WHEN obs_date < a.burn_date THEN 'pre' ELSE 'post' END AS phase,
                   median(b8) AS b8, median(b12) AS b12
                 FROM (SELECT DISTINCT patch_id, burn_date FROM burned WHERE burn_date IS NOT NULL) a
                 JOIN obs o ON a.patch_id = o.patch_id
                   AND (obs_date BETWEEN burn_date - 90 AND burn_date - 1
                        OR obs_date BETWEEN burn_date + 30 AND burn_date + 120)
                 GROUP BY ALL)
           GROUP BY ALL""",
    ),
    "severity": (
        ["burned", "phases"],
        """SELECT patch_id, reference_date, burn_date, pre.nir AS pre_nir, pre.swir2 AS pre_swir2,
             post.nir AS post_nir, post.swir2 AS post_swir2,
             (pre.nir - pre.swir2) / nullif(pre.nir + pre.swir2, 0) AS pre_nbr,
             (post.nir - post.swir2) / nullif(post.nir + post.swir2, 0) AS post_nbr
           FROM burned
           LEFT JOIN (SELECT * FROM phases WHERE phase = 'pre') pre USING (patch_id, burn_date)
           LEFT JOIN (SELECT * FROM phases WHERE phase = 'post') post USING (patch_id, burn_date)""",
    ),
    "labels_view": (
        ["counts", "severity"],
        """SELECT *, CASE WHEN clipped IS NULL THEN NULL WHEN clipped <= 0.27e0 THEN 0 WHEN clipped <= 0.44e0 THEN 1 ELSE 2 END AS y_sev_cls
           FROM (SELECT c.*, s.* EXCLUDE (patch_id, reference_date),
                   CAST(c7 > 0 AS INTEGER) AS y_occ_7d, CAST(c30 > 0 AS INTEGER) AS y_occ_30d, CAST(c60 > 0 AS INTEGER) AS y_occ_60d,
                   CASE WHEN c60 > 0 AND pre_nbr - post_nbr IS NOT NULL
                     THEN greatest(-0.1e0, least(pre_nbr - post_nbr, 1.3e0)) END AS clipped
                 FROM counts c JOIN severity s USING (patch_id, reference_date))""",
    ),
    "indices": (
        ["optical", "counts"],
        """SELECT patch_id, reference_date, images, (b8 - b4) / nullif(b8 + b4, 0) AS ndvi,
             (b8 - b11) / nullif(b8 + b11, 0) AS ndmi,
             2.5e0 * ((b8 - b4) / nullif(b8 + 6e0 * b4 - 7.5e0 * b2 + 1e0, 0)) AS evi,
             (b8 - b12) / nullif(b8 + b12, 0) AS nbr
           FROM counts LEFT JOIN optical USING (patch_id, reference_date)""",
    ),
}


def with_views(body: str, *names: str) -> str:
    """The query with the views it needs (and those they need) in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body


def rounded(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """Round every double column; adding 0.0 turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), special.get(n, digits)) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def rnd(expression: str, digits: int = 9) -> str:
    return f"round({expression}, {digits}) + 0e0"
