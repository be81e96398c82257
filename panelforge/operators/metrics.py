"""Evaluation of prediction tables, one row per model.

Everything that depends on the order of scores comes from one *ladder*: a row
per model and distinct score with its positives and negatives and their running
sums. Rows with equal scores meet before any ordering, and the running sums are
spread over slices, so a model (or a score) with most of the rows is no bottleneck.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import uniform_bin
from ..functions.labels import clip
from ..functions.missing import nan_to_null
from ..session import staged
from .keys import KEYS
from .ordered import first_hits, running_sums, tie_digest
from .splits import has_prefix

SCORES = {"raw": "y_prob", "calibrated": "y_prob_calibrated"}
DEFAULT_TOP_K = (100, 500)  # fixed values
RISK_SUBSET = "severity_available_intersection"  # fixed value
GROUP = ["model", "score"]


def with_model(df: DataFrame, name: str = "model") -> DataFrame:
    """Prediction tables of a single model get a ``model`` column."""
    return df if "model" in df.columns else df.withColumn("model", F.lit(name))


def score_columns(df: DataFrame) -> dict[str, str]:
    return {kind: c for kind, c in SCORES.items() if c in df.columns}


def unpivot_scores(df: DataFrame) -> DataFrame:
    """Long form: one row per prediction and available score (raw, calibrated).

    Models without a calibrated score, in a table where others have one, give no such rows.
    """
    df = with_model(df)
    pairs = F.array(
        *[
            F.struct(F.lit(kind).alias("score"), F.col(c).cast("double").alias("y_score"))
            for kind, c in score_columns(df).items()
        ]
    )
    keys = [k for k in KEYS if k in df.columns]
    long = df.select("model", *keys, F.col("y_true").cast("int").alias("y_true"), F.inline(pairs))
    return long.withColumn("y_score", nan_to_null(F.col("y_score"))).filter(F.col("y_score").isNotNull())


def score_ladder(long: DataFrame, *, lead: bool = False, by: Sequence[str] = GROUP, slices: int | None = None) -> DataFrame:
    """Distinct scores in descending order with running true and false positives, as a written table that all else reads.

    Columns: ``y_score, pos, neg, tp, fp, n_pos, n_neg`` (and ``next_pos/next_neg``). Rows are
    counted per distinct score once, into a written table; its quantiles cut the order, as every distinct
    score is one row of the work to come.
    """
    counted = long.groupBy(*by, "y_score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")
    )
    sums = running_sums(
        staged(counted, "scores"), by=by, value="y_score", sums=["pos", "neg"], lead=["pos", "neg"] if lead else [], slices=slices
    )
    renamed = {"cum_pos": "tp", "cum_neg": "fp", "total_pos": "n_pos", "total_neg": "n_neg"}
    return staged(sums.withColumnsRenamed(renamed), "ladder")


def f1(tp: Column, predicted: Column, actual: Column) -> Column:
    """2tp / (predicted + actual), 0.0 when both are empty."""
    return F.coalesce(F.try_divide(2.0 * tp, predicted + actual), F.lit(0.0))


def ladder_metrics(ladder: DataFrame, bins: int = 10) -> DataFrame:
    """Per model and score: AUC, average precision, trapezoid PR area, ECE, best F1, F1 at 0.5.

    Summed per bin first, then per group; the second step sees ``bins + 1`` rows.
    """
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    n_pos, n_neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    precision = F.try_divide(tp, tp + fp)
    before = F.coalesce(F.try_divide(tp - pos, tp - pos + fp - neg), F.lit(1.0))
    gained = F.try_divide(pos, n_pos)
    rung_f1 = f1(tp, tp + fp, n_pos)
    count = F.col("pos") + F.col("neg")
    per_bin = ladder.groupBy(*GROUP, uniform_bin(F.col("y_score"), bins).alias("bin")).agg(
        F.sum(pos * ((n_neg - fp) + 0.5 * neg)).alias("pairs"),
        F.sum(gained * precision).alias("ap"),
        F.sum(gained * (precision + before) / 2).alias("pr_area"),
        F.max(rung_f1).alias("best"),
        F.sum(count).alias("n"),
        F.sum("pos").alias("hits"),
        F.sum(F.col("y_score") * count).alias("mass"),
        F.sum(F.when(F.col("y_score") >= 0.5, F.col("pos")).otherwise(0)).alias("tp_half"),
        F.sum(F.when(F.col("y_score") >= 0.5, count).otherwise(0)).alias("alerts_half"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("hits") / F.col("n") - F.col("mass") / F.col("n")) * F.col("n"))
    out = per_bin.groupBy(*GROUP).agg(
        F.sum("pairs").alias("pairs"),
        F.sum("ap").alias("ap"),
        F.sum("pr_area").alias("pr_area"),
        F.max("best").alias("best"),
        F.sum("n").alias("n"),
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("gap"),
        F.sum("tp_half").alias("tp_half"),
        F.sum("alerts_half").alias("alerts_half"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )
    # the lowest of the thresholds that reach the best F1
    rungs = ladder.select(*GROUP, "y_score", rung_f1.alias("best")).join(out.select(*GROUP, "best"), [*GROUP, "best"])
    out = out.join(rungs.groupBy(*GROUP).agg(F.min("y_score").alias("best_at")), GROUP)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    area = F.try_divide("pairs", F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return out.select(
        *GROUP,
        F.col("n").alias("n_samples"),
        (F.col("n_pos") / F.col("n")).alias("prevalence"),
        F.when(both, area).alias("roc_auc"),
        F.when(both, F.col("ap")).alias("pr_auc"),
        F.when(both, F.col("pr_area")).alias("pr_trapezoid"),
        (F.col("gap") / F.col("n")).alias("ece"),
        F.when(both, F.col("best_at")).otherwise(0.5).alias("best_threshold"),
        F.when(both, F.col("best")).otherwise(0.0).alias("best_f1"),
        f1(F.col("tp_half"), F.col("alerts_half"), F.col("n_pos")).alias("f1_half"),
    )


def _ranked(df: DataFrame, bins: int = 10) -> DataFrame:
    return ladder_metrics(score_ladder(unpivot_scores(df)), bins)


def roc_auc(df: DataFrame) -> DataFrame:
    """Exact area with ties counted half; NULL with one class."""
    return _ranked(df).select(*GROUP, "roc_auc")


def average_precision(df: DataFrame) -> DataFrame:
    """Step-wise average precision, and the trapezoid area used on PR curves."""
    return _ranked(df).select(*GROUP, "pr_auc", "pr_trapezoid")


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error; a score of 1.0 is in no bin but stays in the denominator."""
    stats = bin_stats(df, bins)
    gap = F.abs(F.col("observed_frequency") - F.col("mean_prediction")) * F.col("count")
    return stats.groupBy(*GROUP).agg(
        (F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), gap)), F.lit(0.0)) / F.sum("count")).alias("ece")
    )


def bin_stats(df: DataFrame, bins: int = 10) -> DataFrame:
    """Count, mean score and observed rate per bin; bin NULL holds scores outside [0, 1)."""
    return (
        unpivot_scores(df)
        .groupBy(*GROUP, uniform_bin(F.col("y_score"), bins).alias("bin"))
        .agg(
            F.avg("y_score").alias("mean_prediction"),
            F.avg(F.col("y_true").cast("double")).alias("observed_frequency"),
            F.count("*").alias("count"),
        )
    )


def best_f1_threshold(df: DataFrame) -> DataFrame:
    """Score threshold with the best F1; the lowest one on ties, (0.5, 0.0) with one class."""
    return _ranked(df).select(*GROUP, "best_threshold", "best_f1")


def topk_hits(rows: DataFrame, ladder: DataFrame, ks: Sequence[int], *, by: Sequence[str]) -> DataFrame:
    """Positives among the k best scores, in columns ``caught_<k>``, for any k.

    ``ladder`` has a row per group and distinct score with ``pos``, ``neg`` and their running sums ``tp``, ``fp``: all
    scores above the one where the count crosses k are settled by it. Of ``rows`` (``score``, ``hit``, ``digest``)
    only those that share this score are looked at, in the order of the digest.
    """
    by = list(by)
    upto, own = F.col("tp") + F.col("fp"), F.col("pos") + F.col("neg")
    parts = []
    for k in ks:
        crosses = (upto > k) & (upto - own < k)
        parts += [
            F.coalesce(F.max(F.when(upto <= k, F.col("tp"))), F.lit(0)).alias(f"full_{k}"),
            F.max(F.when(crosses, F.col("y_score"))).alias(f"edge_{k}"),
            F.max(F.when(crosses, k - (upto - own))).alias(f"rest_{k}"),
        ]
    settled = ladder.groupBy(*by).agg(*parts)
    edges = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"edge_{k}").alias("edge"), F.col(f"rest_{k}").alias("rest")) for k in ks])
    edges = settled.select(*by, F.inline(edges)).filter("edge is not null")
    ties = rows.join(edges.withColumnRenamed("edge", "score"), [*by, "score"])
    found = first_hits(ties.select(*by, "k", "rest", "digest", "hit"), by=[*by, "k"])
    wide = found.groupBy(*by).agg(*[F.sum(F.when(F.col("k") == k, F.col("hits"))).alias(f"tied_{k}") for k in ks])
    return settled.join(wide, by, "left").select(
        *by, *[(F.col(f"full_{k}") + F.coalesce(f"tied_{k}", F.lit(0))).alias(f"caught_{k}") for k in ks]
    )


def _hit_rows(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    x = nan_to_null(F.col(score).cast("double")) + F.lit(0.0)
    rows = df.select(*by, x.alias("score"), (F.col("y_true") > 0).cast("long").alias("hit"), tie_digest(KEYS).alias("digest"))
    return rows.filter("score is not null")


def topk_recall(
    df: DataFrame,
    ks: Sequence[int],
    *,
    score: str = "y_prob",
    by: Sequence[str] = ("model",),
    name: str = "topk_recall",
    extra: Sequence[Column] = (),
    ladder: DataFrame | None = None,
) -> DataFrame:
    """Share of positives among the k best scores; ``k`` beyond the rows takes all rows.

    Ties go by a digest of patch and date. No positives give 0.0. ``extra`` aggregates ride along
    with the totals, in the same pass. ``ladder`` may bring the score's ladder where there is one.
    """
    if min(ks) <= 0:
        raise ValueError("k must be positive")
    df = with_model(df)
    by = list(by)
    rows = _hit_rows(df, score, by)
    if ladder is None:
        ladder = score_ladder(rows.select(*by, F.col("score").alias("y_score"), F.col("hit").alias("y_true")), by=by)
    caught = topk_hits(rows, ladder, ks, by=by)
    totals = df.groupBy(*by).agg(F.sum((F.col("y_true") > 0).cast("long")).alias("_pos"), F.count("*").alias("_n"), *extra)
    others = [c for c in totals.columns if c not in (*by, "_pos", "_n")]
    return totals.join(caught, by, "left").select(
        *by,
        F.col("_n").alias("n"),
        *others,
        *[F.coalesce(F.try_divide(F.col(f"caught_{k}"), F.col("_pos")), F.lit(0.0)).alias(f"{name}_{k}") for k in ks],
    )


def evaluate_occurrence(df: DataFrame, *, bins: int = 10, topk: Sequence[int] | None = None) -> DataFrame:
    """Full occurrence report, one row per model; calibrated columns when present.

    Best thresholds are taken on these very rows: an upper bound, not for deployment.
    """
    df = with_model(df)
    ks = list(topk or DEFAULT_TOP_K)
    scores = score_columns(df)
    truth = F.col("y_true") == 1
    guess = F.col("y_prob") >= 0.5
    if "y_pred" in df.columns:
        guess = F.coalesce(F.col("y_pred") == 1, guess)
    counts = {"n_tp": truth & guess, "n_alert": guess, "n_true": truth}
    deploys = "calibrated" in scores and "occurrence_decision_threshold" in df.columns
    extra = []
    if deploys:
        alert = F.col("y_prob_calibrated") >= F.col("occurrence_decision_threshold")
        counts |= {"n_tp_deployed": truth & alert, "n_deployed": alert}
        extra = [F.max("occurrence_decision_threshold").alias("deployment_threshold")]
    rungs = score_ladder(unpivot_scores(df))
    extra = [*[F.count_if(c).alias(n) for n, c in counts.items()], *extra]
    base = topk_recall(df, ks, extra=extra, ladder=rungs.filter("score = 'raw'"))

    ladder = ladder_metrics(rungs, bins)
    raw = F.col("score") == "raw"

    def pick(column: str, out: str, kind: Column = raw) -> Column:
        return F.max(F.when(kind, F.col(column))).alias(out)

    columns = [
        pick("roc_auc", "roc_auc"),
        pick("pr_auc", "pr_auc"),
        pick("ece", "ece_raw"),
        pick("n_samples", "n_samples"),
        pick("prevalence", "prevalence"),
        pick("best_threshold", "optimal_threshold"),
        pick("best_f1", "optimal_f1"),
        pick("best_threshold", "oracle_threshold_raw"),
        pick("best_f1", "oracle_f1_raw"),
    ]
    if "calibrated" in scores:
        cal = F.col("score") == "calibrated"
        columns += [
            pick("ece", "ece_calibrated", cal),
            pick("f1_half", "f1_calibrated", cal),
            pick("roc_auc", "roc_auc_calibrated", cal),
            pick("best_threshold", "oracle_threshold_calibrated", cal),
            pick("best_f1", "oracle_f1_calibrated", cal),
        ]
    ranked = ladder.groupBy("model").agg(*columns)
    out = base.join(ranked, "model")
    deployed = [
        F.col("deployment_threshold"),
        F.when(
            F.col("deployment_threshold").isNotNull(), f1(F.col("n_tp_deployed"), F.col("n_deployed"), F.col("n_true"))
        ).alias("f1_calibrated_deployment"),
    ]
    return out.select(
        "model",
        F.lit("occurrence").alias("task"),
        f1(F.col("n_tp"), F.col("n_alert"), F.col("n_true")).alias("f1"),
        *[c for c in ranked.columns if c != "model"],
        *[F.when(F.col("n") >= k, F.col(f"topk_recall_{k}")).alias(f"topk_recall_{k}") for k in ks],
        *(deployed if deploys else []),
    )


def evaluate_severity_cls(df: DataFrame) -> DataFrame:
    """Long form: precision, recall, F1 and support per model and class (true or predicted)."""
    df = with_model(df)
    t, p = F.col("y_true").cast("int"), F.col("y_pred").cast("int")
    cells = df.groupBy("model", t.alias("t"), p.alias("p")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    sides = cells.select(
        "model",
        F.inline(
            F.array(
                F.struct(
                    F.col("t").alias("class"),
                    F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero).alias("tp"),
                    zero.alias("predicted"),
                    F.col("n").alias("support"),
                ),
                F.struct(F.col("p").alias("class"), zero.alias("tp"), F.col("n").alias("predicted"), zero.alias("support")),
            )
        ),
    )
    per_class = sides.groupBy("model", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    return per_class.select(
        "model",
        "class",
        F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"),
        f1(F.col("tp"), F.col("predicted"), F.col("support")).alias("f1"),
        "support",
    )


def severity_cls_summary(df: DataFrame, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """One row per model: macro F1, rows, and the per-class figures of ``classes``.

    A class outside the list is an error, as the wide form has no columns for it.
    """
    per_class = evaluate_severity_cls(df)
    unlisted = F.raise_error(F.concat(F.lit("class outside the list of classes: "), F.col("class").cast("string")))
    listed = F.when(F.col("class").isin(*classes), F.col("f1")).otherwise(unlisted.cast("double"))
    wide = [
        F.max(F.when(F.col("class") == c, F.col(m))).alias(f"class_{c}_{m}")
        for c in classes
        for m in ("precision", "recall", "support")
    ]
    return per_class.groupBy("model").agg(
        F.lit("severity_cls").alias("task"), F.avg(listed).alias("sev_macro_f1"), F.sum("support").alias("n_samples"), *wide
    )


def evaluate_severity_reg(df: DataFrame) -> DataFrame:
    """MAE, RMSE, means, population deviations and correlation (0.0 where undefined)."""
    df = with_model(df)
    t, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    out = df.groupBy("model").agg(
        F.lit("severity_reg").alias("task"),
        F.avg(F.abs(t - p)).alias("sev_mae"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("sev_rmse"),
        F.count("*").alias("n_samples"),
        F.avg(t).alias("y_true_mean"),
        F.stddev_pop(t).alias("y_true_std"),
        F.avg(p).alias("y_pred_mean"),
        F.stddev_pop(p).alias("y_pred_std"),
        F.covar_pop(t, p).alias("_cov"),
    )
    defined = (F.col("n_samples") > 1) & (F.col("y_true_std") > 0) & (F.col("y_pred_std") > 0)
    # not ``corr``: in ANSI mode it raises for a constant column
    r = F.try_divide(F.col("_cov"), F.col("y_true_std") * F.col("y_pred_std"))
    return out.withColumn("correlation", F.when(defined, r).otherwise(0.0)).drop("_cov")


def risk_pairs(occ: DataFrame, sev: DataFrame) -> DataFrame:
    """Occurrence and severity predictions of the same patch and date, with expected risk.

    Each pair of models meets on the keys; the calibrated probability wins when present.
    """
    prob = F.coalesce(*[F.col(c) for c in ("y_prob_calibrated", "y_prob") if c in occ.columns])
    left = with_model(occ).select(F.col("model").alias("occ_model"), *KEYS, "y_true", prob.alias("p"))
    right = with_model(sev).select(F.col("model").alias("sev_model"), *KEYS, F.col("y_pred").alias("sev_pred"))
    return left.join(right, KEYS).withColumn("expected_risk", F.col("p") * F.col("sev_pred"))


def evaluate_combined_risk(occ: DataFrame, sev: DataFrame, *, topk: Sequence[int] | None = None) -> DataFrame:
    """Risk figures for every occurrence x severity model; pairs without common keys have n = 0.

    Severity is predicted where it is available only, so the figures rank rows within that part; the
    column ``combined_risk_subset`` says so.
    """
    ks = list(topk or DEFAULT_TOP_K)
    by = ["occ_model", "sev_model"]
    if any(k not in sev.columns for k in KEYS):
        return with_model(occ).select(
            F.col("model").alias("occ_model"),
            F.lit(None).cast("string").alias("sev_model"),
            F.lit("combined_risk").alias("task"),
            F.lit(0).cast("long").alias("combined_risk_n"),
        ).distinct()
    pairs = risk_pairs(occ, sev)
    spread = [
        F.avg("expected_risk").alias("expected_risk_mean"),
        F.stddev_pop("expected_risk").alias("expected_risk_std"),
    ]
    found = topk_recall(pairs, ks, score="expected_risk", by=by, name="combined_topk_recall", extra=spread)
    # the grid of model names: one short list per side, put together by a scalar subquery
    names = with_model(sev).agg(F.collect_set("model").alias("names"))
    models = (
        with_model(occ)
        .select(F.col("model").alias("occ_model"))
        .distinct()
        .withColumn("names", names.scalar())
        .select("occ_model", F.explode("names").alias("sev_model"))
    )
    out = models.join(found, by, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return out.select(
        *by,
        F.lit("combined_risk").alias("task"),
        n.alias("combined_risk_n"),
        F.when(n > 0, F.lit(RISK_SUBSET)).alias("combined_risk_subset"),
        "expected_risk_mean",
        "expected_risk_std",
        *[F.when(n >= k, F.col(f"combined_topk_recall_{k}")).alias(f"combined_topk_recall_{k}") for k in ks],
    )


def spatial_subset_metrics(
    df: DataFrame, prefixes: Sequence[str], task: str, *, bins: int = 10, topk: Sequence[int] | None = None
) -> DataFrame:
    """The task's report on rows of some id prefixes, columns prefixed ``spatial_``.

    Models without such rows keep a row with ``spatial_holdout_n`` = 0.
    """
    df = with_model(df)
    subset = df.filter(has_prefix(prefixes))
    if task == "occurrence":
        found = evaluate_occurrence(subset, bins=bins, topk=topk)
    elif task == "severity_cls":
        found = severity_cls_summary(subset)
    else:
        found = evaluate_severity_reg(subset)
    named = found.withColumnsRenamed({c: f"spatial_{c}" for c in found.columns if c != "model"})
    everyone = df.select("model").distinct()
    return everyone.join(named, "model", "left").withColumn(
        "spatial_holdout_n", F.coalesce(F.col("spatial_n_samples"), F.lit(0))
    )


def comparison_table(reports: Sequence[DataFrame]) -> DataFrame:
    """All reports in one table keyed by model; figures a report lacks are NULL."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


# Name hints of severity models.
CLS_HINTS = ("severity_cls", "sev_cls")
REG_HINTS = ("severity_reg", "sev_reg")


def infer_task(df: DataFrame) -> DataFrame:
    """Task of each model: by score column, then by name, then by what it predicts
    (at most ten distinct whole numbers make it a classifier)."""
    if not {"y_prob", "y_pred"} & set(df.columns):
        raise ValueError("predictions have neither y_prob nor y_pred")
    df = with_model(df)
    name = F.lower("model")

    def hinted(hints: Sequence[str]) -> Column:
        hit = F.lit(False)
        for h in hints:
            hit = hit | name.contains(h)
        return hit

    prob = F.count("y_prob") if "y_prob" in df.columns else F.lit(0)
    pred = F.col("y_pred").cast("double") if "y_pred" in df.columns else F.lit(None).cast("double")
    # only whole numbers are told apart: fractions settle the task, however many there are
    whole = F.when(pred == F.floor(pred), pred)
    per_value = df.groupBy("model", whole.alias("v")).agg(
        prob.alias("scored"), F.count_if(pred != F.floor(pred)).alias("fractions")
    )
    per_model = per_value.groupBy("model").agg(
        F.sum("scored").alias("scored"),
        F.count("v").alias("distinct_values"),
        (F.sum("fractions") == 0).alias("whole"),
    )
    task = (
        F.when(F.col("scored") > 0, "occurrence")
        .when(hinted(CLS_HINTS), "severity_cls")
        .when(hinted(REG_HINTS), "severity_reg")
        .when((F.col("distinct_values") <= 10) & F.col("whole"), "severity_cls")
        .otherwise("severity_reg")
    )
    return per_model.select("model", task.alias("task"))


def multitask_loss(
    df: DataFrame,
    *,
    occurrence_weight: float = 1.0,
    severity_weight: float = 0.5,
    pos_weight: float = 1.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean weighted logistic loss plus severity squared error over available rows.

    Columns: ``logit, sev_pred, y_occ, y_sev, mask``. The logistic term is stable
    for large logits of either sign.
    """
    x, y, m = F.col("logit"), F.col("y_occ").cast("double"), F.col("mask").cast("double")
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    bce = (1.0 - y) * x + (1.0 + (pos_weight - 1.0) * y) * soft
    miss = F.col("sev_pred") - F.col("y_sev").cast("double")
    out = df.groupBy(*by).agg(
        F.avg(bce).alias("occurrence_loss"),
        F.coalesce(F.sum(m * miss * miss) / (F.sum(m) + 1e-8), F.lit(0.0)).alias("severity_loss"),
    )
    return out.withColumn("loss", occurrence_weight * F.col("occurrence_loss") + severity_weight * F.col("severity_loss"))


def expected_risk(p_fire: Column, severity: Column) -> Column:
    return p_fire * severity


def prediction_table(
    panel: DataFrame,
    fire: DataFrame,
    severity: DataFrame,
    *,
    threshold: float | None = None,
) -> DataFrame:
    """Keys, centroids when present, probability, severity (not below 0) and their product.

    Joined on the keys, never by position. ``threshold`` adds the alert columns.
    """
    meta = [*KEYS, *[c for c in ("centroid_lat", "centroid_lon") if c in panel.columns]]
    out = (
        panel.select(*meta)
        .join(fire.select(*KEYS, "p_fire"), KEYS)
        .join(severity.select(*KEYS, "severity_conditional"), KEYS)
        .withColumn("severity_conditional", clip(F.col("severity_conditional"), low=0.0))
        .withColumn("expected_risk", expected_risk(F.col("p_fire"), F.col("severity_conditional")))
    )
    return with_alert(out, threshold) if threshold is not None else out


def with_alert(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("fire_alert", (F.col("p_fire") >= threshold).cast("int")).withColumn(
        "fire_alert_threshold", F.lit(float(threshold))
    )


def inference_summary(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of the outputs, alerts and their share."""
    figures = []
    for c in ("p_fire", "severity_conditional", "expected_risk"):
        figures += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.agg(
        F.count("*").alias("n"),
        *figures,
        F.sum("fire_alert").alias("n_alerts"),
        F.avg(F.col("fire_alert").cast("double")).alias("alert_share"),
    )
