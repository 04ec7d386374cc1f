"""The whole study: bars to features, regimes, predictions, portfolio, statistics and report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.config import Settings
from tickerloom.operators import cleaning, features, metrics, models, portfolio, quality, regime, reports, statistics
from tickerloom.sources import tables as io


@dataclass
class StudyResult:
    feature_matrix: DataFrame
    regimes: DataFrame
    predictions: DataFrame
    daily: DataFrame
    tables: dict[str, DataFrame]


def run_study(raw_bars: DataFrame, raw_index: DataFrame | None, work_folder: str, settings: Settings = Settings(),
              changes: DataFrame | None = None, members: DataFrame | None = None) -> StudyResult:
    """Runs every stage. The feature matrix, the regimes and the predictions are written below ``work_folder`` and read
    back, so later stages start from stored rows and a lost executor costs a re-read, not a recomputation."""
    spark = raw_bars.sparkSession
    bars = cleaning.process_bars(raw_bars, settings.features.limit_pct, settings.features.limit_tolerance)
    index_source = portfolio.equal_weight_index(bars) if raw_index is None else raw_index
    index = cleaning.process_index(index_source)
    matrix = _stored(spark, features.build_feature_matrix(bars, index, settings.features, settings.target),
                     f"{work_folder}/features")
    regimes = _stored(spark, regime.detect_regime(index, settings.regime), f"{work_folder}/regimes")
    predictions = models.run_walk_forward(matrix, regimes, settings.folds, settings.model)
    predictions = _stored(spark, predictions, f"{work_folder}/predictions", by_year=False)
    ensemble = portfolio.keep_latest_fold(predictions.where(F.col("model") == "ensemble"))
    static = portfolio.keep_latest_fold(predictions.where(F.col("model") == "static"))
    daily = portfolio.simulate_portfolio(ensemble, bars, changes, members, settings.portfolio)
    daily_static = portfolio.simulate_portfolio(static, bars, changes, members, settings.portfolio)
    daily = _stored(spark, daily.join(daily_static.select("date", F.col("strategy_return").alias("static_return")), "date"),
                    f"{work_folder}/daily", by_year=False)
    per_fold = reports.fold_metrics(predictions)
    pair = predictions.where(F.col("model").isin("ensemble", "static")).groupBy("fold", "date", "ticker", "y_true").pivot(
        "model", ["ensemble", "static"]).agg(F.first("y_proba"))
    dm = statistics.diebold_mariano(pair, first="ensemble", second="static", order=("fold", "date", "ticker"))
    dm_returns = statistics.diebold_mariano_returns(daily, first="strategy_return", second="static_return")
    boot = statistics.sharpe_bootstrap_ci(daily, n_bootstrap=settings.statistics.n_bootstrap, seed=settings.statistics.seed)
    figures = metrics.portfolio_metrics(daily, trading_days=settings.portfolio.trading_days)
    long_figures = figures.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in figures.columns])).alias("_m")).select(
        F.lit("portfolio").alias("context"), "_m.name", "_m.value")
    result = {
        "model_comparison": reports.model_comparison(per_fold), "model_table": reports.model_table(per_fold),
        "regime_performance": reports.regime_performance(predictions), "portfolio_metrics": figures,
        "significance": statistics.significance_table({"ensemble vs static": dm, "returns": dm_returns}, {"sharpe": boot}),
        "integrity": quality.integrity_report(long_figures),
    }
    for name, table in result.items():
        io.sink_csv(table, f"{work_folder}/tables/{name}")
    return StudyResult(matrix, regimes, predictions, daily, result)


def _stored(spark: SparkSession, df: DataFrame, path: str, by_year: bool = True) -> DataFrame:
    io.sink_parquet(df, path, by_year)
    out = spark.read.parquet(path)
    return out.drop("year") if by_year else out
