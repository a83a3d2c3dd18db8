"""Evaluation aggregates. All are distributed aggregations (partial aggregate per
task, one small exchange, final aggregate); predictions are never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _labelled(label: str) -> Column:
    return F.col(label).isNotNull()


def compute_metrics(pred: str = "pred", label: str = "label",
                    nll: str | None = "nll") -> dict[str, Column]:
    """Metric callback: name -> aggregate Column. Unlabelled rows are left out of
    every metric and counted separately; a labelled row without a prediction
    (e.g. a NULL feature vector) counts as wrong."""
    hit = F.when(_labelled(label),
                 F.coalesce(F.col(pred) == F.col(label), F.lit(False)).cast("double"))
    metrics = {
        "accuracy": F.avg(hit),
        "n_correct": F.coalesce(F.sum(hit), F.lit(0.0)).cast("long"),
        "n_labelled": F.count(F.when(_labelled(label), 1)).cast("long"),
        "n_unlabelled": F.count(F.when(~_labelled(label), 1)).cast("long"),
    }
    if nll is not None:
        metrics["mean_nll"] = F.avg(F.when(_labelled(label), F.col(nll)))
    return metrics


def evaluate(df: DataFrame, pred: str = "pred", label: str = "label", nll: str | None = "nll",
             by: list[str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row of metrics (or one per ``by`` group, e.g. per round)."""
    m = dict(compute_metrics(pred, label, nll))
    m.update(extra or {})
    aggs = [c.alias(n) for n, c in m.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def accuracy(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    return evaluate(df, pred, label, nll=None).select("accuracy")


def correct_total(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    return evaluate(df, pred, label, nll=None).select(
        "n_correct", F.col("n_labelled").alias("n_total"))


def compare_results(df: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Old vs new result on one table: (agreement summary, old x new counts). Every row
    counts: two NULL results agree, a NULL and a value differ."""
    summary = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(old).eqNullSafe(F.col(new)).cast("long")).alias("n_agree"),
        F.avg(F.col(old).eqNullSafe(F.col(new)).cast("double")).alias("agreement"))
    confusion = df.groupBy(F.col(old).alias("old_result"), F.col(new).alias("new_result")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))
    return summary, confusion
