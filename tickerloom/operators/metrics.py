"""Classification, regression and portfolio metrics as grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.columns import div
from tickerloom.functions.scan import same_keys, sorted_scan


def _score_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score; rows of equal score combine before any shuffle."""
    return df.groupBy(*keys, F.col("y_proba").alias("p")).agg(
        F.count(F.when(F.col("y_true") == 1, 1)).alias("pos"), F.count(F.when(F.col("y_true") != 1, 1)).alias("neg"))


def auc_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL with one class only."""
    scanned = sorted_scan(_score_counts(df, keys), keys, ["p"], {"cum_neg": "neg", "cum_pos": "pos"}, totals=True)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0)
    return scanned.groupBy(*keys).agg(div(
        F.sum(F.col("pos") * below), F.max(F.col("cum_pos_total") * F.col("cum_neg_total").cast("double"))).alias("auc_roc"))


def classification_metrics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1_score (0 where undefined), auc_roc, log_loss per group of ``keys``."""
    tagged = df if keys else df.withColumn("_g", F.lit(0))
    group = list(keys) or ["_g"]
    hit = (F.col("y_true") == 1) & (F.col("y_pred") == 1)
    p = F.greatest(F.least(F.col("y_proba"), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.when(F.col("y_true") == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))
    counts = tagged.groupBy(*group).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        F.count(F.when(hit, 1)).alias("_tp"), F.count(F.when(F.col("y_pred") == 1, 1)).alias("_pp"),
        F.count(F.when(F.col("y_true") == 1, 1)).alias("_ap"), F.avg(loss).alias("log_loss"),
        F.count(F.lit(1)).alias("n_samples"), F.avg(F.col("y_true").cast("double")).alias("pos_rate"))
    zero = F.lit(0.0)
    rates = counts.select(
        *group, "accuracy", F.coalesce(div("_tp", F.col("_pp").cast("double")), zero).alias("precision"),
        F.coalesce(div("_tp", F.col("_ap").cast("double")), zero).alias("recall"),
        F.coalesce(div(F.lit(2.0) * F.col("_tp"), (F.col("_pp") + F.col("_ap")).cast("double")), zero).alias("f1_score"),
        "log_loss", "n_samples", "pos_rate")
    return same_keys(rates, auc_by(tagged, group), group).select(
        *keys, "accuracy", "precision", "recall", "f1_score", "auc_roc", "log_loss", "n_samples", "pos_rate")


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), actual: str = "y_true", predicted: str = "y_pred"
                       ) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    spread = F.count(F.lit(1)) * F.var_pop(F.col(actual))
    return df.groupBy(*keys).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - div(F.sum(error * error), spread)).alias("r2"))


def equity_curve(daily: DataFrame, keys: Sequence[str] = (), value: str = "strategy_return") -> DataFrame:
    """Compounded growth, its running peak and the drawdown. One row per calendar day and group."""
    line = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.withColumn("equity", F.product(F.lit(1.0) + F.col(value)).over(line))
    peaked = grown.withColumn("peak", F.max("equity").over(line))
    return peaked.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def worst_tail(daily: DataFrame, keys: Sequence[str] = (), value: str = "strategy_return", share: float = 0.05
               ) -> DataFrame:
    """Mean of the lowest max(1, int(share*n)) returns."""
    group = Window.partitionBy(*keys)
    ranked = daily.select(*keys, value, F.row_number().over(group.orderBy(value)).alias("_r"),
                          F.count(F.lit(1)).over(group).alias("_n"))
    tail = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))
    return ranked.where(tail).groupBy(*keys).agg(F.avg(value).alias("cvar_95"))


def portfolio_metrics(daily: DataFrame, keys: Sequence[str] = (), value: str = "strategy_return",
                      trading_days: int = 252) -> DataFrame:
    """Annualised return, risk and drawdown figures per group; a daily table is bounded by the calendar."""
    tagged = daily if keys else daily.withColumn("_g", F.lit(0))
    group = list(keys) or ["_g"]
    curve = equity_curve(tagged, group, value)
    base = curve.groupBy(*group).agg(
        F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"), F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"), F.max_by("equity", "date").alias("_last"))
    ret, vol = F.col("_mean") * trading_days, F.col("_std") * math.sqrt(trading_days)
    zero = F.lit(0.0)
    out = base.join(worst_tail(tagged, group, value), group)
    return out.select(
        *keys, ret.alias("ann_return"), vol.alias("ann_vol"), F.coalesce(div(ret, vol), zero).alias("sharpe"),
        "max_drawdown", F.coalesce(div(ret, F.abs("max_drawdown")), zero).alias("calmar"), "cvar_95", "hit_rate",
        (F.col("_last") - 1).alias("total_return"))


def regime_stratified_metrics(daily: DataFrame, value: str = "strategy_return", trading_days: int = 252) -> DataFrame:
    """Portfolio metrics of each regime's days, and of all days as 'overall'."""
    groups = F.explode(F.array(F.col("regime").cast("string"), F.lit("overall")))
    return portfolio_metrics(daily.withColumn("regime_group", groups), ["regime_group"], value, trading_days)


def pr_curve(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 at every distinct score taken as threshold, closed by (1.0, precision 1, recall 0)."""
    scanned = sorted_scan(_score_counts(df, keys), keys, ["p"], {"cum_pos": "pos", "cum_neg": "neg"}, totals=True)
    tp = F.col("cum_pos_total") - F.col("cum_pos") + F.col("pos")
    fp = F.col("cum_neg_total") - F.col("cum_neg") + F.col("neg")
    points = scanned.select(*keys, F.col("p").alias("threshold"), (tp / (tp + fp).cast("double")).alias("precision"),
                            F.coalesce(div(tp, F.col("cum_pos_total").cast("double")), F.lit(1.0)).alias("recall"),
                            F.lit(0).alias("closing"))
    groups = df.select(*keys).distinct() if keys else df.agg(F.count(F.lit(1)).alias("_n")).select()
    closing = groups.select(*keys, F.lit(1.0).alias("threshold"), F.lit(1.0).alias("precision"),
                            F.lit(0.0).alias("recall"), F.lit(1).alias("closing"))
    both = points.unionByName(closing)
    product, total = F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
    return both.withColumn("f1_score", F.lit(2.0) * div(product, total))


def best_threshold_fbeta(df: DataFrame, beta: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold of the highest F-beta, lowest on ties."""
    curve = pr_curve(df, keys)
    b2 = F.lit(beta * beta)
    f = F.coalesce(div((b2 + 1) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")),
                   F.lit(0.0))
    best = curve.groupBy(*keys).agg(F.min(F.struct(
        (-f).alias("neg"), "closing", "threshold", "precision", "recall")).alias("_b"))
    return best.select(*keys, F.col("_b.threshold").alias("threshold"), F.col("_b.precision").alias("precision"),
                       F.col("_b.recall").alias("recall"), (-F.col("_b.neg")).alias("fbeta"))


def best_threshold_min_precision(df: DataFrame, min_precision: float = 0.60, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold of the highest recall with enough precision; the highest precision if none has enough."""
    curve = pr_curve(df, keys)
    enough = F.col("precision") >= min_precision
    rank = F.struct(F.when(enough, 0).otherwise(1).alias("miss"),
                    F.when(enough, -F.col("recall")).otherwise(-F.col("precision")).alias("neg"), "closing", "threshold")
    best = curve.groupBy(*keys).agg(F.min_by(F.struct("threshold", "precision", "recall"), rank).alias("_b"))
    return best.select(*keys, "_b.threshold", "_b.precision", "_b.recall")


def metric_pivot(fold_metrics: DataFrame, models: Sequence[str], metric: str = "auc_roc") -> DataFrame:
    """Fold by model table of one metric. Model names are given, so no job is spent on finding them."""
    return fold_metrics.groupBy("fold").pivot("model", list(models)).agg(F.first(metric))
