"""Registered queries of fitted stages, training runs and scoring."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal
from ..ml import fit as fitting
from ..ml import isotonic, score
from ..ml.transformers import MedianImputer, QuantileNormalizer, Winsorizer
from ..operators import splits
from ..operators.keys import KEYS
from ..session import staged
from . import bindings as b
from .bindings import Tables, rnd, rounded, with_views
from .catalog import QUERIES, SPLIT_ENDS, SPLIT_SQL, query  # noqa: F401

FEATURES = ["weather_balance", "optical_price", "terrain_prio"]
# Smaller than the defaults, which take minutes a fit on one machine (figures in the README); all rows are used.
FOREST_SIZE = {"n_estimators": 20, "max_depth": 10}
BOOSTED_SIZE = {"n_estimators": 10, "max_depth": 4, "early_stopping_rounds": 3}


def _panel(t: Tables) -> DataFrame:
    return splits.temporal_split(t.order_panel, **SPLIT_ENDS)


def _stored_panel(t: Tables) -> DataFrame:
    """The panel as training gets it: a written table, as fitting, checks and predictions each read it again."""
    return staged(_panel(t), "panel")


def _out(prefix: str) -> list[str]:
    return [f"{prefix}_{c}" for c in FEATURES]


_TRAIN = f"(SELECT * FROM order_panel WHERE reference_date <= DATE '{b.TRAIN_END}')"


def _clip_sql(c: str) -> str:
    low, high = (f"(SELECT quantile_cont({c}, {p}) FROM {_TRAIN})" for p in (0.01, 0.99))
    return f"CASE WHEN {c} IS NOT NULL THEN {rnd(f'greatest(least({c}, {high}), {low})', 6)} END AS clipped_{c}"


@query(
    "winsorize",
    with_views(
        f"""SELECT patch_id, reference_date, {', '.join(_clip_sql(c) for c in FEATURES)} FROM order_panel
        WHERE reference_date <= DATE '{b.TEST_END}'""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    panel = _panel(t)
    model = Winsorizer(inputCols=FEATURES, outputCols=_out("clipped")).fit(panel.filter("split = 'train'"))
    return rounded(model.transform(panel).select(*KEYS, *_out("clipped")), 6)


@query(
    "median_impute",
    with_views(
        f"""SELECT patch_id, reference_date,
          {', '.join(f'''{rnd(f'coalesce({c}, (SELECT median({c}) FROM {_TRAIN}))', 6)} AS filled_{c},
          CAST({c} IS NULL AS DOUBLE) AS {c}__missing''' for c in FEATURES)}
        FROM order_panel WHERE reference_date <= DATE '{b.TEST_END}'""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    panel = _panel(t)
    imputer = MedianImputer(inputCols=FEATURES, outputCols=_out("filled"), indicators=True)
    model = imputer.fit(panel.filter("split = 'train'"))
    return rounded(model.transform(panel).select(*KEYS, *_out("filled"), *model.indicator_columns()), 6)


def _polynomial_sql(coefficients: list[float], x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def _normal_sql(c: str) -> str:
    """Rows with the normal quantile of a column: knots, the knot at or below, the share
    between, and the inverse normal distribution."""
    tail = f"({_polynomial_sql(normal.TAIL_NUM, 'z')} / {_polynomial_sql(normal.TAIL_DEN, 'z')})"
    centre = f"((q - 0.5e0) * {_polynomial_sql(normal.CENTRE_NUM, 'z')} / {_polynomial_sql(normal.CENTRE_DEN, 'z')})"
    probs = ", ".join(repr(i / 499) for i in range(500))
    return f"""(
      WITH raw AS (SELECT unnest(quantile_cont({c}, [{probs}])) AS k, generate_subscripts(quantile_cont({c}, [{probs}]), 1) - 1 AS i FROM {_TRAIN}),
      knots AS (SELECT *, lead(k) OVER (ORDER BY k) AS nk, lead(a) OVER (ORDER BY k) AS na FROM (
        SELECT k, min(i) / 499e0 AS a, max(i) / 499e0 AS b FROM raw GROUP BY k)),
      shares AS (SELECT patch_id, reference_date,
          CASE WHEN x IS NULL THEN NULL WHEN x < (SELECT min(k) FROM knots) + 1e-7 THEN 0 WHEN x > (SELECT max(k) FROM knots) - 1e-7 THEN 1
            WHEN x = k THEN (a + b) / 2 ELSE b + (x - k) / (nk - k) * (na - b) END AS share
        FROM (SELECT patch_id, reference_date, {c} AS x FROM order_panel WHERE reference_date <= DATE '{b.TEST_END}') r
        ASOF LEFT JOIN knots ON x >= k)
      SELECT patch_id, reference_date, CASE WHEN share IS NULL THEN NULL WHEN abs(q - 0.5e0) <= 0.5e0 - {normal.TAIL_FROM}e0 THEN {centre}
          WHEN q < 0.5e0 THEN {tail} ELSE -{tail} END AS v
      FROM (SELECT *, CASE WHEN abs(q - 0.5e0) <= 0.5e0 - {normal.TAIL_FROM}e0 THEN (q - 0.5e0) * (q - 0.5e0) ELSE sqrt(-2e0 * ln(least(q, 1e0 - q))) END AS z
            FROM (SELECT *, least(greatest(share, 1e-7), 1e0 - 1e-7) AS q FROM shares)))"""


@query(
    "quantile_normalize",
    with_views(
        f"""SELECT patch_id, reference_date, {', '.join(f'{rnd(f"n{i}.v", 6)} AS normal_{c}' for i, c in enumerate(FEATURES))}
        FROM {_normal_sql(FEATURES[0])} n0 JOIN {_normal_sql(FEATURES[1])} n1 USING (patch_id, reference_date)
        JOIN {_normal_sql(FEATURES[2])} n2 USING (patch_id, reference_date)""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    panel = _panel(t)
    model = QuantileNormalizer(inputCols=FEATURES, outputCols=_out("normal")).fit(panel.filter("split = 'train'"))
    return rounded(model.transform(panel).select(*KEYS, *_out("normal")), 6)


_ISOTONIC = f"""points AS (SELECT model, y_prob AS x, count(*) AS n, sum(y_true) AS s FROM occurrence
      WHERE reference_date > DATE '{b.TRAIN_END}' AND reference_date <= DATE '{b.VAL_END}' GROUP BY ALL),
    sums AS (SELECT model, x, row_number() OVER w AS k, sum(n) OVER w AS n, sum(s) OVER w AS s FROM points WINDOW w AS (PARTITION BY model ORDER BY x)),
    starts AS (SELECT model, k, n, s FROM sums UNION ALL SELECT DISTINCT model, 0, 0, 0 FROM sums),
    least_means AS (SELECT i.model, j.k, min((j.s - i.s) * 1e0 / (j.n - i.n)) OVER (PARTITION BY i.model, i.k ORDER BY j.k DESC) AS v
      FROM starts i JOIN sums j ON i.model = j.model AND j.k > i.k),
    steps AS (SELECT model, x, v FROM sums JOIN (SELECT model, k, max(v) AS v FROM least_means GROUP BY model, k) USING (model, k)),
    found AS (SELECT t.*, p.x AS px, p.v AS pv FROM (SELECT * FROM occurrence WHERE reference_date > DATE '{b.VAL_END}' AND reference_date <= DATE '{b.TEST_END}') t
      ASOF LEFT JOIN steps p ON t.model = p.model AND t.y_prob >= p.x)"""


@query(
    "isotonic_calibrate",
    with_views("", "occurrence") + ", " + _ISOTONIC + f""" SELECT f.model, patch_id, reference_date, y_true, y_prob,
      {rnd('CASE WHEN pv IS NULL THEN n.v WHEN n.v IS NULL OR px = y_prob THEN pv ELSE pv + (y_prob - px) / (n.x - px) * (n.v - pv) END')} AS y_prob_calibrated
    FROM found f ASOF LEFT JOIN steps n ON f.model = n.model AND f.y_prob <= n.x""",
)
def _(t: Tables) -> DataFrame:
    """Both models, fitted on the validation rows and applied to the test rows."""
    split = splits.temporal_split(t.occurrence.select("model", *KEYS, "y_true", "y_prob"), **SPLIT_ENDS)
    blocks = staged(isotonic.isotonic_blocks(split.filter("split = 'val'"), group="model"), "blocks")
    out = isotonic.calibrated(split.filter("split = 'test'").drop("split"), blocks, group="model")
    return out.withColumn("y_prob_calibrated", F.round("y_prob_calibrated", 9) + F.lit(0.0))


@query(
    "capped_sample",
    with_views(
        f"""SELECT patch_id, reference_date, {rnd('optical_price')} AS optical_price FROM order_panel
        ORDER BY md5(patch_id || '|' || reference_date || '|42') LIMIT 500""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(score.capped_sample(t.order_panel).select(*KEYS, "optical_price"))


# A trained model has no SQL, but its rows do: which they are, their truth, and what must hold of every prediction.
_TEST = f"(SELECT * FROM order_panel WHERE reference_date > DATE '{b.VAL_END}' AND reference_date <= DATE '{b.TEST_END}')"
_ALL = f"(SELECT * FROM order_panel WHERE reference_date <= DATE '{b.TEST_END}')"
_SEVERE = "y_sev_available = 1"


def _counts_sql(where: str = "TRUE") -> str:
    parts = {"train": f"reference_date <= DATE '{b.TRAIN_END}'", "val": f"reference_date > DATE '{b.TRAIN_END}' AND reference_date <= DATE '{b.VAL_END}'", "test": f"reference_date > DATE '{b.VAL_END}'"}
    return ", ".join(f"count(*) FILTER (WHERE {where} AND {c}) AS n_{k}" for k, c in parts.items())


def _share(column: str):
    return F.col(column).between(0.0, 1.0)


def _fire_rows(fit: fitting.Fit) -> DataFrame:
    """Every test row: both probabilities are probabilities, and both alerts follow from them."""
    tuned = (F.col("y_prob_calibrated") >= F.col("occurrence_decision_threshold")).cast("int") == F.col("y_pred_calibrated_tuned")
    plain = (F.col("y_prob") >= 0.5).cast("int") == F.col("y_pred")
    return fit.predictions.select(*KEYS, "y_true", (_share("y_prob") & _share("y_prob_calibrated")).alias("probabilities"), (tuned & plain).alias("alerts"))


def _fire_report(fit: fitting.Fit) -> DataFrame:
    """What the report says of the data, and that its figures are in range and the threshold is one it tried."""
    figures = ("f1", "roc_auc", "pr_auc", "ece_raw", "ece_calibrated", "optimal_threshold", "optimal_val_f1")
    good = _share(figures[0])
    for c in figures[1:]:
        good = good & _share(c)
    names = ["model", "n_features", "n_train", "n_val", "n_test", "train_positive_rate", "test_positive_rate", "train_nan_rate"]
    return rounded(fit.report.select(*names, good.alias("in_range")))


_FIRE_REPORT_SQL = f"""SELECT '{{model}}' AS model, 3 AS n_features, {_counts_sql()},
  {rnd(f"avg(y_occ_30d) FILTER (WHERE reference_date <= DATE '{b.TRAIN_END}')")} AS train_positive_rate,
  {rnd(f"avg(y_occ_30d) FILTER (WHERE reference_date > DATE '{b.VAL_END}')")} AS test_positive_rate,
  (SELECT {rnd('(avg(CAST(weather_balance IS NULL AS INTEGER)) + avg(CAST(optical_price IS NULL AS INTEGER)) + avg(CAST(terrain_prio IS NULL AS INTEGER))) / 3')} FROM {_TRAIN}) AS train_nan_rate,
  TRUE AS in_range FROM {_ALL}"""


@query(
    "fit_occurrence",
    with_views(f"SELECT patch_id, reference_date, y_occ_30d AS y_true, TRUE AS probabilities, TRUE AS alerts FROM {_TEST}", "order_panel"),
)
def _(t: Tables) -> DataFrame:
    return _fire_rows(fitting.fit_occurrence(_stored_panel(t), fitting.LOGREG))


@query("fit_occurrence_forest", with_views(_FIRE_REPORT_SQL.format(model="random_forest"), "order_panel"))
def _(t: Tables) -> DataFrame:
    return _fire_report(fitting.fit_occurrence(_stored_panel(t), fitting.FOREST, FOREST_SIZE))


@query("fit_occurrence_boosted", with_views(_FIRE_REPORT_SQL.format(model="boosted"), "order_panel"))
def _(t: Tables) -> DataFrame:
    return _fire_report(fitting.fit_occurrence(_stored_panel(t), fitting.BOOSTED, BOOSTED_SIZE))


@query(
    "fit_severity_cls",
    with_views(
        f"SELECT patch_id, reference_date, y_sev_cls AS y_true, TRUE AS shares, TRUE AS likeliest, {{}} FROM {_TEST} CROSS JOIN (SELECT {_counts_sql(_SEVERE)} FROM {_ALL}) WHERE {_SEVERE}".format("n_train, n_val, n_test"),
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    """Class probabilities of every test row sum to 1 and the likeliest class is the one predicted."""
    fit = fitting.fit_severity_cls(_stored_panel(t), BOOSTED_SIZE)
    probs = F.col("y_probs")
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    shares = (F.abs(total - 1.0) < 1e-9) & (F.size(probs) == 3) & F.forall(probs, lambda x: x.between(0.0, 1.0))
    likeliest = F.element_at(probs, F.col("y_pred") + 1) == F.array_max(probs)
    sizes = fit.report.select("n_train", "n_val", "n_test").first()
    rows = fit.predictions.select(*KEYS, "y_true", shares.alias("shares"), likeliest.alias("likeliest"))
    return rows.select("*", *[F.lit(sizes[c]).cast("long").alias(c) for c in ("n_train", "n_val", "n_test")])


@query(
    "fit_severity_reg",
    with_views(f"SELECT patch_id, reference_date, {rnd('y_sev_reg')} AS y_true, TRUE AS in_range FROM {_TEST} WHERE {_SEVERE}", "order_panel"),
)
def _(t: Tables) -> DataFrame:
    """Every test row has a prediction, within a third of the span of training values beyond them."""
    panel = _stored_panel(t)
    fit = fitting.fit_severity_reg(panel, BOOSTED_SIZE)
    seen = panel.filter("split = 'train' and y_sev_available = 1").agg(F.min("y_sev_reg"), F.max("y_sev_reg")).first()
    slack = (seen[1] - seen[0]) / 3
    return rounded(fit.predictions.select(*KEYS, "y_true", F.col("y_pred").between(seen[0] - slack, seen[1] + slack).alias("in_range")))


@query(
    "score_panel",
    with_views(f"SELECT patch_id, reference_date, TRUE AS probabilities, TRUE AS severities, TRUE AS risks, TRUE AS alerts FROM {_ALL}", "order_panel"),
)
def _(t: Tables) -> DataFrame:
    """Every row of the panel scored: probabilities, severities from 0 on, their product, and the alert at the tuned threshold."""
    panel = _stored_panel(t)
    fire = fitting.fit_occurrence(panel, fitting.LOGREG)
    scored = score.score_panel(panel, fire, fitting.fit_severity_reg(panel, BOOSTED_SIZE))
    return scored.select(
        *KEYS, (_share("p_fire") & _share("p_fire_raw")).alias("probabilities"), (F.col("severity_conditional") >= 0).alias("severities"),
        (F.abs(F.col("expected_risk") - F.col("p_fire") * F.col("severity_conditional")) < 1e-12).alias("risks"),
        ((F.col("p_fire") >= fire.threshold).cast("int") == F.col("fire_alert")).alias("alerts"),
    )


_FEATURES_SQL = f"SELECT unnest({FEATURES}) AS feature, TRUE AS fits"


@query("feature_importances", f"{_FEATURES_SQL}")
def _(t: Tables) -> DataFrame:
    """Every feature of a forest has an importance; together they are 1."""
    found = score.top_features(score.feature_importances(fitting.fit_occurrence(_stored_panel(t), fitting.FOREST, FOREST_SIZE)), 30)
    whole = F.abs(F.sum("importance").over(Window.partitionBy(F.lit(0))) - 1) < 1e-9  # three rows
    return found.select("feature", (whole & (F.col("importance") >= 0)).alias("fits"))


def _attributed(panel: DataFrame, fit: fitting.Fit) -> DataFrame:
    """Every feature's mean absolute share, which can't exceed the whole spread its coefficients give."""
    got = score.linear_attribution(panel, fit)
    return got.select("feature", (F.col("mean_abs_attribution") >= 0).alias("fits"))


@query("linear_attribution", f"{_FEATURES_SQL}")
def _(t: Tables) -> DataFrame:
    panel = _stored_panel(t)
    return _attributed(panel, fitting.fit_occurrence(panel, fitting.LOGREG))


@query("linear_attribution_classes", f"{_FEATURES_SQL}")
def _(t: Tables) -> DataFrame:
    """Shares of a model with one output per severity class, averaged over outputs."""
    panel = _stored_panel(t)
    return _attributed(panel, fitting.fit_severity_cls(panel, model_name=fitting.LOGREG))


def balanced_weights(t: Tables) -> DataFrame:
    return splits.with_balanced_weight(_panel(t), "y_occ_30d")


@query(
    "balanced_weights",
    with_views(
        f"""SELECT patch_id, reference_date, y_occ_30d, {rnd('n * 1e0 / (2 * c)')} AS weight FROM (
          SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY y_occ_30d) AS c FROM order_panel
          WHERE reference_date <= DATE '{b.TEST_END}')""",
        "order_panel",
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(balanced_weights(t).select(*KEYS, "y_occ_30d", F.col("weight")))
