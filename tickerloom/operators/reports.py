"""Report tables over long predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.metrics import classification_metrics
from tickerloom.operators.regime import REGIME_NAMES

TABLE_METRICS = ("auc_roc", "f1_score", "accuracy", "precision", "recall")

MODEL_FAMILIES = {
    "base": "Boosted trees (base)", "transfer": "Boosted trees (transfer)", "ensemble": "Ensemble",
    "static": "Boosted trees (static)", "second": "Random forest", "random": "Random", "hold": "Buy and hold",
}


def fold_metrics(predictions: DataFrame) -> DataFrame:
    return classification_metrics(predictions, ["fold", "model"])


def fold_summary(metrics: DataFrame, names: Sequence[str] = TABLE_METRICS + ("log_loss",)) -> DataFrame:
    """Mean and sample deviation over folds per model."""
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_mean"), F.stddev_samp(n).alias(f"{n}_std")]
    return metrics.groupBy("model").agg(*aggs)


def mean_std_text(name: str) -> Column:
    """'0.5435 ± 0.0368'; with a single fold the deviation reads nan."""
    mean = F.coalesce(F.format_string("%.4f", F.col(f"{name}_mean")), F.lit("nan"))
    std = F.when(F.col(f"{name}_std").isNull(), "nan").otherwise(F.format_string("%.4f", F.col(f"{name}_std")))
    return F.concat(mean, F.lit(" ± "), std)


def model_table(metrics: DataFrame) -> DataFrame:
    return fold_summary(metrics, TABLE_METRICS).select("model", *[mean_std_text(n).alias(n) for n in TABLE_METRICS])


def model_comparison(metrics: DataFrame) -> DataFrame:
    names = TABLE_METRICS + ("log_loss",)
    family = F.col("model")
    for model, label in MODEL_FAMILIES.items():
        family = F.when(F.col("model") == model, label).otherwise(family)
    out = fold_summary(metrics, names).select(
        "model", family.alias("type"), *[F.col(f"{n}_{s}") for n in names for s in ("mean", "std")],
        *[mean_std_text(n).alias(n) for n in names])
    return out.orderBy(F.col("auc_roc_mean").desc(), "model")


def regime_performance(predictions: DataFrame, model: str = "ensemble") -> DataFrame:
    """Pooled metrics of one model per named regime; overlapping test windows count as often as they occur."""
    name = F.concat(F.lit("State "), F.col("regime").cast("string"))
    for number, label in REGIME_NAMES.items():
        name = F.when(F.col("regime") == number, label).otherwise(name)
    rows = predictions.where((F.col("model") == model) & F.col("regime").isNotNull())
    return classification_metrics(rows.withColumn("regime_name", name), ["regime_name"])


def pooled_metrics(predictions: DataFrame) -> DataFrame:
    return classification_metrics(predictions, ["model"])
