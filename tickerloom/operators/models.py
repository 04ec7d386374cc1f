"""Walk-forward training and scoring with pyspark.ml, score blending, baselines, ablation and importance."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.config import FoldSettings, ModelSettings
from tickerloom.functions.columns import hash_uniform
from tickerloom.functions.scan import sorted_scan
from tickerloom.operators import boosting
from tickerloom.operators import folds as fold_ops
from tickerloom.operators.alignment import assign_folds, regime_confidence, regime_for_dates
from tickerloom.operators.boosting import Boosted, BoostSettings, CutRows
from tickerloom.operators.cleaning import date_range_split, feature_columns, inf_to_null
from tickerloom.session import stored

FEATURES, LABEL, PROBABILITY = "_features", "label", "y_proba"


def assemble(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol=FEATURES, handleInvalid="keep").transform(df)


def booster(settings: ModelSettings, rounds: int | None = None, step: float | None = None,
            weights: str | None = None, validation: str | None = None) -> GBTClassifier:
    estimator = GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, maxDepth=settings.max_depth, stepSize=step or settings.step_size,
        maxIter=rounds or settings.max_rounds, subsamplingRate=settings.subsample, seed=settings.seed,
        maxBins=32, cacheNodeIds=False)
    if weights:
        estimator = estimator.setWeightCol(weights)
    if validation:
        estimator = estimator.setValidationIndicatorCol(validation)
    return estimator


def forest(settings: ModelSettings) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=LABEL, numTrees=settings.forest_trees,
                                  maxDepth=settings.max_depth, subsamplingRate=settings.subsample, seed=settings.seed)


def score(model, df: DataFrame, out: str = PROBABILITY) -> DataFrame:
    """Class-1 probability; the model's own columns are dropped."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def predict_binary(p: Column | str, threshold: float = 0.5) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return (c >= threshold).cast("int")


def ensemble_score(base: Column, adapted: Column | None, confidence: Column | None = None,
                   settings: ModelSettings = ModelSettings()) -> Column:
    """Weighted mean of base and adapted score; a confident regime moves weight to the adapted model."""
    if adapted is None:
        return base
    if confidence is None:
        return F.lit(settings.weight_base) * base + F.lit(settings.weight_adapted) * adapted
    w = F.lit(settings.weight_adapted) * confidence
    return (F.lit(1.0) - w) * base + w * adapted


def random_baseline(df: DataFrame, seed: int = 42, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """A uniform score per row, drawn from the row's key: repeated runs and retried tasks give the same number."""
    return df.withColumn(PROBABILITY, hash_uniform(F.lit(seed), *keys))


def hold_baseline(df: DataFrame) -> DataFrame:
    return df.withColumn(PROBABILITY, F.lit(0.0))


@dataclass(frozen=True)
class Variant:
    """Switches of the adapted model."""

    name: str
    transfer: bool = True
    regime: bool = True
    alpha: float | None = None


ABLATION_VARIANTS = (
    Variant("base", transfer=False, regime=False, alpha=1.0),
    Variant("transfer", regime=False, alpha=1.0),
    Variant("transfer_regime", alpha=1.0),
    Variant("transfer_decay", regime=False),
    Variant("full"),
)


def base_settings(settings: ModelSettings) -> BoostSettings:
    return BoostSettings(settings.max_rounds, settings.step_size, settings.max_depth, settings.max_leaves, settings.l1, settings.l2, settings.min_leaf_rows,
                         column_share=settings.column_share, patience=settings.patience, seed=settings.seed)


def second_settings(settings: ModelSettings) -> BoostSettings:
    """The other library's habits: no limit on leaves, a least hessian instead of least rows, a share of the rows for each tree."""
    return replace(base_settings(settings), max_leaves=2 ** settings.max_depth, min_rows=1, min_hessian=float(settings.min_leaf_rows), row_share=settings.subsample, seed=settings.seed + 1)


def fit_base(train: DataFrame, names: Sequence[str], settings: ModelSettings = ModelSettings()) -> Boosted:
    """Boosted trees of every fold, grown side by side; with an ``is_valid`` column, a fold ends once its validation AUC has not risen for ``patience`` rounds."""
    return boosting.fit_boosted(train, names, base_settings(settings), valid="is_valid" if "is_valid" in train.columns else None)


def fit_second(train: DataFrame, names: Sequence[str], settings: ModelSettings = ModelSettings()) -> Boosted:
    return boosting.fit_boosted(train, names, second_settings(settings), valid="is_valid" if "is_valid" in train.columns else None)


def transfer_rows(train: DataFrame, current: DataFrame | None, alpha: float, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """Each fold's rows of its ``current`` regime (all if they are few), validation rows included, weighted by age."""
    rows = train if current is None else fold_ops.regime_filter(train, current, min_rows=settings.min_regime_rows)
    return fold_ops.time_decay_weights(rows, alpha)


def transfer_cuts(names: Sequence[str], rows: DataFrame, settings: ModelSettings = ModelSettings(), alike: Mapping[int, int] | None = None) -> CutRows:
    """``transfer_rows`` as ``fit_transfer`` reads them; they need no base model, so they can be made while it grows."""
    return boosting.cut_rows(rows, names, base_settings(settings).bins, weight="weight", alike=alike)


def fit_transfer(base: Boosted, rows: DataFrame | CutRows, settings: ModelSettings = ModelSettings()) -> Boosted:
    """Continues the base model on ``transfer_rows``: its trees stay, short rounds at a smaller step follow."""
    tuned = replace(base_settings(settings), rounds=settings.fine_tune_rounds, step=settings.fine_tune_step, patience=None, seed=settings.seed + 2)
    cut = rows if isinstance(rows, CutRows) else transfer_cuts(base.features, rows, settings)
    binned = boosting.put_in_bins(cut, base)
    fitted = boosting.grow_boosted(binned, tuned)
    binned.remove()
    return fitted


def training_table(features: DataFrame, regime: DataFrame, names: Sequence[str]) -> DataFrame:
    """Feature rows with the regime of their date, the same for all folds. Infinite values become missing; the rows stay. Only the days' regimes are written."""
    by_date = stored(regime_for_dates(regime, features.select("date")))
    return inf_to_null(features.join(F.broadcast(by_date), "date"), names)  # a row for each day of the calendar


@dataclass(frozen=True)
class FoldRows:
    """Rows of all usable folds, tagged with ``fold``; ``skipped`` lists the others with their row counts."""

    train: DataFrame
    test: DataFrame
    skipped: DataFrame
    folds: tuple[fold_ops.Fold, ...]


def fold_rows(table: DataFrame, folds: Sequence[fold_ops.Fold], settings: FoldSettings = FoldSettings()) -> FoldRows:
    """Deals a table to its folds: training rows (with ``is_valid``; the last ``purge_days`` before the end are left out) and test rows.

    A row is in many folds, so folds are not written: each reader deals the rows of ``table`` anew, without a shuffle. A table that is dear to make is stored before."""
    if not folds:
        raise ValueError("the dates are too few for a fold")
    if settings.purge_days:
        folds = [replace(f, train_end=_minus_days(f.train_end, settings.purge_days)) for f in folds]
    assigned = assign_folds(table, folds)
    sizes = fold_ops.fold_sizes(assigned, settings)
    usable = {r["fold"] for r in sizes.where("usable").select("fold").collect()}
    kept = tuple(f for f in folds if f.fold in usable)
    if not kept:
        raise ValueError("no fold has enough rows")
    mine = assigned.where(F.col("fold").isin(sorted(usable)))
    train = fold_ops.train_valid_split(mine.where("part = 'train'").drop("part"), fraction=settings.valid_fraction, min_rows=settings.min_valid_rows)
    return FoldRows(train, mine.where("part = 'test'").drop("part"), sizes.where("NOT usable").drop("usable"), kept)


def _minus_days(day, n):
    from datetime import timedelta

    return day - timedelta(days=n)


def current_regimes(rows: FoldRows, regime: DataFrame, from_test: bool = False) -> DataFrame:
    """(fold, current_regime) that the adapted model is tuned to: as known at the end of training, or (``from_test``) the test period's mode; 1 if unknown."""
    if from_test:
        days = rows.test.select("fold", "date").distinct()
        found = fold_ops.current_regime(days.join(regime_for_dates(regime, days.select("date")), "date"))
    else:
        known = F.array_compact(F.array(*[F.when(F.col("date") <= F.lit(f.train_end), F.lit(f.fold)) for f in rows.folds]))
        found = regime.where(F.col("regime").isNotNull()).select("date", "regime", F.explode(known).alias("fold")).groupBy("fold").agg(F.max_by("regime", "date").alias("current_regime"))
    spark = rows.train.sparkSession
    every = spark.createDataFrame([(f.fold,) for f in rows.folds], "fold int")
    return every.join(found, "fold", "left").select("fold", F.coalesce("current_regime", F.lit(1)).cast("int").alias("current_regime"))


def _confidence(rows: FoldRows, regime: DataFrame) -> DataFrame:
    return regime_confidence(regime, rows.test.select("fold", "date")).select("fold", F.col("confidence").cast("double").alias("_confidence"))


@dataclass(frozen=True)
class FittedFolds:
    base: Boosted
    second: Boosted
    transfer: Boosted


def fit_folds(rows: FoldRows, regime: DataFrame, names: Sequence[str], settings: ModelSettings = ModelSettings(), regime_from_test: bool = False) -> FittedFolds:
    """The models of every fold. All folds' trees of one kind grow together, so the number of jobs does not depend on the number of folds.

    The second model grows on the base model's binned rows, beside it and the model that continues it, whose rows are cut meanwhile."""
    binned = boosting.bin_rows(rows.train, names, base_settings(settings).bins, valid="is_valid")
    apart = inheritable_thread_target(rows.train.sparkSession)
    with ThreadPoolExecutor(2) as beside:
        second = beside.submit(apart(boosting.grow_boosted), binned, second_settings(settings))
        tuned = beside.submit(apart(lambda: transfer_cuts(names, transfer_rows(rows.train, current_regimes(rows, regime, regime_from_test), settings.decay_alpha, settings), settings)))
        base = boosting.grow_boosted(binned, base_settings(settings))
        transfer = fit_transfer(base, tuned.result(), settings)
        fitted = FittedFolds(base, second.result(), transfer)
    binned.remove()
    return fitted


def fold_predictions(rows: FoldRows, fitted: FittedFolds, regime: DataFrame, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """Long predictions (fold, date, ticker, model, y_true, y_proba, y_pred, regime) of every model on every fold's test rows."""
    scored = rows.test
    for name, model in (("base", fitted.base), ("second", fitted.second), ("transfer", fitted.transfer)):
        scored = boosting.score(model, scored, "fold", name)
    scored = scored.join(_confidence(rows, regime), "fold", "left").withColumns({
        # The retrained-from-scratch model has the same data and settings as the base model.
        "static": F.col("base"), "random": hash_uniform(F.lit(settings.seed), "date", "ticker"), "hold": F.lit(0.0),
        "ensemble": ensemble_score(F.col("base"), F.col("transfer"), F.coalesce("_confidence", F.lit(0.5)), settings)})
    return long_predictions(scored, ["base", "transfer", "ensemble", "static", "second", "random", "hold"], settings.threshold)


def run_walk_forward(features: DataFrame, regime: DataFrame, fold_settings: FoldSettings = FoldSettings(),
                     settings: ModelSettings = ModelSettings(), regime_from_test: bool = False,
                     folds: Sequence[fold_ops.Fold] | None = None) -> DataFrame:
    """Long predictions of every model on every fold; ``regime`` is one series keyed by date with ``regime`` and ``state_prob``."""
    names = feature_columns(features)
    table = stored(training_table(features, regime, names), measured=True)
    rows = fold_rows(table, fold_ops.data_folds(table, fold_settings) if folds is None else folds, fold_settings)
    return fold_predictions(rows, fit_folds(rows, regime, names, settings, regime_from_test), regime, settings)


def long_predictions(scored: DataFrame, models: Iterable[str], threshold: float = 0.5) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models]))
    rows = scored.select("fold", "date", "ticker", F.col(LABEL).alias("y_true"), "regime", pairs.alias("_m"))
    return rows.select("fold", "date", "ticker", F.col("_m.model").alias("model"), "y_true",
                       F.col("_m.p").alias("y_proba"), predict_binary("_m.p", threshold).alias("y_pred"), "regime")


def run_ablation(features: DataFrame, regime: DataFrame, fold_settings: FoldSettings = FoldSettings(),
                 settings: ModelSettings = ModelSettings(), variants: Sequence[Variant] = ABLATION_VARIANTS,
                 folds: Sequence[fold_ops.Fold] | None = None) -> DataFrame:
    """Predictions of each variant on every fold, in the walk-forward layout with the variant as model. The base is fitted once;
    the adapted models of all variants and folds are grown side by side, each under a number of its own."""
    names = feature_columns(features)
    table = stored(training_table(features, regime, names), measured=True)
    rows = fold_rows(table, fold_ops.data_folds(table, fold_settings) if folds is None else folds, fold_settings)
    return ablation_predictions(rows, fit_base(rows.train, names, settings), regime, settings, variants)


def ablation_predictions(rows: FoldRows, base: Boosted, regime: DataFrame, settings: ModelSettings = ModelSettings(), variants: Sequence[Variant] = ABLATION_VARIANTS) -> DataFrame:
    adapted = [v for v in variants if v.transfer]
    scored = boosting.score(base, rows.test, "fold", "_base")
    if adapted:
        step = 1 + max(f.fold for f in rows.folds)
        current = current_regimes(rows, regime)
        tuned, begin, alike = None, Boosted(base.features, {}, {}, {}, {}), {}
        first = {r: next(i for i, v in enumerate(adapted) if v.regime == r) for r in {v.regime for v in adapted}}  # variants of one rule differ in weights only
        for i, v in enumerate(adapted):
            mine = transfer_rows(rows.train, current if v.regime else None, settings.decay_alpha if v.alpha is None else v.alpha, settings)
            mine = mine.withColumn("fold", F.col("fold") + i * step)
            tuned = mine if tuned is None else tuned.unionByName(mine)
            for k in base.trees:
                begin.start[k + i * step], begin.trees[k + i * step] = base.start[k], base.trees[k]
                alike[k + i * step] = k + first[v.regime] * step
        model = fit_transfer(begin, transfer_cuts(base.features, tuned, settings, alike), settings)
        for i, v in enumerate(adapted):
            scored = boosting.score(model, scored.withColumn("_key", F.col("fold") + i * step), "_key", f"_{v.name}").drop("_key")
    scored = scored.join(_confidence(rows, regime), "fold", "left")
    confidence = F.coalesce("_confidence", F.lit(0.5))
    columns = {v.name: ensemble_score(F.col("_base"), F.col(f"_{v.name}"), confidence, settings) if v.transfer else F.col("_base") for v in variants}
    return long_predictions(scored.withColumns(columns), list(columns), settings.threshold)


def feature_importance(model: Boosted, spark) -> DataFrame:
    """(fold, feature, importance): the gains of a feature's splits, summed; unused features have zero."""
    return model.importance(spark).select(F.col("fit").cast("int").alias("fold"), "feature", F.col("gain").alias("importance"))


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features of each fold; ties by name. A fold has as many rows as the model has features."""
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.col("importance").desc(), "feature"))
    return importance.withColumn("rank", rank).where(F.col("rank") <= n)


def permutation_importance(model: Boosted, rows: DataFrame, seed: int = 42, min_rows: int = 50, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """AUC lost per fold and regime (and overall) when one feature's values are exchanged between a fold's rows.

    Values move along a hash order of the keys: row i takes the value of the row next to it in that order, so a shuffled
    copy is one shift. All features are scored in one pass by exploding rows over the features.
    """
    from tickerloom.operators.metrics import auc_by

    names = model.features
    base = rows.select("fold", *keys, "regime", LABEL, *names).withColumn("_h", hash_uniform(F.lit(seed), *keys))
    numbered = stored(sorted_scan(base, ["fold"], ["_h", *keys], {"_pos": F.lit(1)}, totals=True))
    donors = numbered.select("fold", (F.pmod(F.col("_pos"), F.col("_pos_total")) + 1).alias("_pos"),
                             F.struct(*names).alias("_other"))
    paired = numbered.join(donors, ["fold", "_pos"])
    changed = [F.struct(F.lit("").alias("feature"), F.struct(*names).alias("x"))]
    for f in names:
        mixed = F.struct(*[(F.col(f"_other.{n}") if n == f else F.col(n)).alias(n) for n in names])
        changed.append(F.struct(F.lit(f).alias("feature"), mixed.alias("x")))
    exploded = paired.select("fold", "regime", LABEL, F.explode(F.array(*changed)).alias("_e")).select(
        "fold", "regime", F.col(LABEL).alias("y_true"), "_e.feature", "_e.x.*")
    scored = boosting.score(model, exploded, "fold").select(
        "fold", "feature", "y_true", "y_proba",
        F.explode(F.array(F.col("regime").cast("string"), F.lit("overall"))).alias("group"))
    scored = stored(scored)
    counts = scored.where(F.col("feature") == "").groupBy("fold", "group").agg(F.count(F.lit(1)).alias("n_rows"))
    auc = stored(auc_by(scored, ["fold", "group", "feature"]))
    whole = auc.where(F.col("feature") == "").select("fold", "group", F.col("auc_roc").alias("_full"))
    return (auc.where(F.col("feature") != "").join(whole, ["fold", "group"]).join(counts, ["fold", "group"])
            .where(F.col("n_rows") >= min_rows)
            .select("fold", "group", "feature", (F.col("_full") - F.col("auc_roc")).alias("auc_drop"), "n_rows"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def small_settings(rounds: int = 5, depth: int = 3, trees: int = 10) -> ModelSettings:
    return replace(ModelSettings(), max_rounds=rounds, max_depth=depth, fine_tune_rounds=rounds, forest_trees=trees)
