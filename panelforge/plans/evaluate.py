"""Evaluating all stored predictions at once: one long table, one report per model."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curves, metrics
from ..session import staged


def tasks(predictions: DataFrame) -> dict[str, list[str]]:
    """Model names by task; one short row per model comes to the driver."""
    found: dict[str, list[str]] = {"occurrence": [], "severity_cls": [], "severity_reg": []}
    for row in metrics.infer_task(predictions).collect():
        found[row["task"]].append(row["model"])
    return found


def of_models(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    return predictions.filter(F.col("model").isin(list(models)))


def evaluate_all(
    predictions: DataFrame,
    *,
    prefixes: Sequence[str] = (),
    bins: int = 10,
    topk: Sequence[int] | None = None,
) -> DataFrame:
    """Comparison table of every model, with its spatial subset when prefixes are given,
    and one ``risk__<occurrence>+<severity>`` row per pair of models.

    Each report reads its predictions several times, so they are written once to the shared folder."""
    predictions = staged(predictions, "predictions")
    by_task = tasks(predictions)
    reports = []

    def add(task: str, report: DataFrame, rows: DataFrame) -> None:
        if prefixes:
            subset = metrics.spatial_subset_metrics(rows, prefixes, task, bins=bins)
            report = report.join(subset, "model", "left")
        reports.append(report)

    occurrence = of_models(predictions, by_task["occurrence"])
    if by_task["occurrence"]:
        add("occurrence", metrics.evaluate_occurrence(occurrence, bins=bins, topk=topk), occurrence)
    if by_task["severity_cls"]:
        rows = of_models(predictions, by_task["severity_cls"])
        add("severity_cls", metrics.severity_cls_summary(rows), rows)
    if by_task["severity_reg"]:
        rows = of_models(predictions, by_task["severity_reg"])
        add("severity_reg", metrics.evaluate_severity_reg(rows), rows)
        if by_task["occurrence"]:
            risk = metrics.evaluate_combined_risk(occurrence, rows, topk=topk)
            name = F.concat(F.lit("risk__"), "occ_model", F.lit("+"), "sev_model")
            reports.append(risk.select(name.alias("model"), *[c for c in risk.columns if c not in ("occ_model", "sev_model")]))
    return metrics.comparison_table(reports)


def research_curves(occurrence: DataFrame | None, severity: DataFrame | None, *, bins: int = 10) -> dict[str, DataFrame]:
    """Every curve table by name, ready for ``write_curves``."""
    tables = {}
    if occurrence is not None:
        tables["roc_pr_curve_points"] = curves.roc_pr_points(occurrence)
        tables["calibration_bins"] = curves.calibration_bins(occurrence, bins)
        tables["threshold_tradeoffs"] = curves.threshold_tradeoff(occurrence)
        tables["cumulative_gain"] = curves.cumulative_gain(occurrence)
    if severity is not None:
        tables["severity_regression_diagnostics"] = curves.residuals(severity)
    return tables
