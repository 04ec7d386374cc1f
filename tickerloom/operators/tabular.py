"""Generic classification and regression on a table: impute, encode, scale, split, fit, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.config import ModelSettings
from tickerloom.functions.columns import div
from tickerloom.functions.scan import exact_quantiles, most_frequent, sorted_scan
from tickerloom.operators.models import FEATURES, assemble, score


def _tall(df: DataFrame, columns: Sequence[str], type_name: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(type_name).alias("v")) for c in columns]))
    return df.select(pairs.alias("_p")).select("_p.column", "_p.v")


def _one_row(tall: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    """(column, value) rows as a single row with one field per column."""
    return tall.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col(value))).alias(c) for c in columns])


def impute_values(df: DataFrame, numeric: Sequence[str], other: Sequence[str]) -> DataFrame:
    """Fill value per column: exact median or most frequent value, 'unknown' if a column has none."""
    parts = []
    if numeric:
        medians = exact_quantiles(_tall(df, numeric, "double"), ["column"], "v", {"fill": 0.5})
        parts.append(medians.select("column", F.col("fill").cast("string").alias("fill")))
    if other:
        modes = most_frequent(_tall(df, other, "string"), ["column"], "v", "fill")
        names = df.sparkSession.createDataFrame([(c,) for c in other], "column string")
        parts.append(names.join(modes, "column", "left").select("column", F.coalesce("fill", F.lit("unknown")).alias("fill")))
    out = parts[0]
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def impute(df: DataFrame, numeric: Sequence[str], other: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fills NULLs from values learned on ``fit_on`` (default: the table itself)."""
    fills = _one_row(impute_values(fit_on if fit_on is not None else df, numeric, other), [*numeric, *other], "fill")
    # A single row of fill values.
    row = F.broadcast(fills.select(F.struct(*fills.columns).alias("_fill"), F.lit(1).alias("_one")))
    joined = df.withColumn("_one", F.lit(1)).join(row, "_one")
    types = dict(df.dtypes)
    filled = {c: F.coalesce(F.col(c), F.col(f"_fill.{c}").cast("double").cast(types[c]) if c in numeric
                            else F.col(f"_fill.{c}").cast(types[c])) for c in [*numeric, *other]}
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in df.columns])


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): codes number the distinct values of a column in string order, from 0."""
    values = _tall(df, columns, "string").where(F.col("v").isNotNull()).distinct()
    ranked = sorted_scan(values, ["column"], ["v"], {"_rank": F.lit(1)})
    return ranked.select("column", F.col("v").alias("value"), (F.col("_rank") - 1).cast("double").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Replaces strings by codes; a value the codes do not know becomes NULL. Joined without a hint: small dictionaries
    are broadcast by their measured size, large ones are shuffled."""
    codes = label_codes(df, columns) if codes is None else codes
    out = df
    for c in columns:
        one = codes.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias(f"_code_{c}"))
        out = out.join(one, c, "left")
    return out.select(*[F.col(f"_code_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def scale_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns])


def standard_scale(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    facts = scale_values(fit_on if fit_on is not None else df, columns)
    # A single row of means and deviations.
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(facts.withColumn("_one", F.lit(1))), "_one")
    scaled = {c: F.when(F.col(c).isNotNull(), F.coalesce(div(F.col(c) - F.col(f"{c}_mean"), f"{c}_std"), F.lit(0.0)))
              for c in columns}
    return joined.select(*[scaled.get(c, F.col(c)).alias(c) for c in df.columns])


def stratified_split(df: DataFrame, key: str, stratum: str | None = None, train_share: float = 0.8, seed: int = 42
                     ) -> DataFrame:
    """Adds ``is_train``: the first floor(share*n) rows of each class in hash order of the key. Any class may hold most of
    the rows; its order is scanned in ranges, not in one task."""
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    group = [stratum] if stratum else []
    ranked = sorted_scan(hashed, group, ["_h", key], {"_rank": F.lit(1)}, totals=True)
    cut = F.floor(F.col("_rank_total") * F.lit(train_share))
    return ranked.withColumn("is_train", F.col("_rank") <= cut).select(*df.columns, "is_train")


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, n_classes: int,
                   settings: ModelSettings = ModelSettings(), rounds: int = 100):
    """Boosted trees for two classes, a random forest for more."""
    rows = assemble(train.withColumn("label", F.col(label).cast("double")), features)
    if n_classes <= 2:
        model = GBTClassifier(featuresCol=FEATURES, labelCol="label", maxIter=rounds, stepSize=settings.step_size,
                              maxDepth=settings.max_depth, seed=settings.seed)
    else:
        model = RandomForestClassifier(featuresCol=FEATURES, labelCol="label", numTrees=rounds,
                                       maxDepth=settings.max_depth, seed=settings.seed)
    return model.fit(rows)


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, settings: ModelSettings = ModelSettings(),
                  rounds: int = 100):
    rows = assemble(train.withColumn("label", F.col(label).cast("double")), features)
    return GBTRegressor(featuresCol=FEATURES, labelCol="label", maxIter=rounds, stepSize=settings.step_size,
                        maxDepth=settings.max_depth, seed=settings.seed).fit(rows)


def score_classifier(model, rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    staged = assemble(rows, features)
    scored = score(model, staged) if model.numClasses == 2 else staged
    predicted = model.transform(scored).select(*scored.columns, F.col("prediction").cast("int").alias("y_pred"))
    return predicted.withColumn("y_true", F.col(label).cast("int")).drop(FEATURES)


def score_regressor(model, rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    scored = model.transform(assemble(rows, features))
    return scored.select(*rows.columns, F.col("prediction").alias("y_pred"), F.col(label).cast("double").alias("y_true"))


def macro_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy and class-averaged precision, recall, F1 from the confusion counts."""
    cells = scored.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(
        F.struct(F.col("y_true").alias("c"), F.col("n").alias("actual"), F.lit(0).alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("y_pred").alias("c"), F.lit(0).alias("actual"), F.col("n").alias("predicted"), F.lit(0).alias("hit"))))
    per_class = cells.select(sides.alias("_s")).select("_s.*").groupBy("c").agg(
        F.sum("actual").alias("a"), F.sum("predicted").alias("p"), F.sum("hit").alias("h"))
    zero = F.lit(0.0)
    share = lambda x, y: F.coalesce(div(x, y.cast("double")), zero)
    return per_class.agg(
        (F.sum("h") / F.sum("a")).alias("accuracy"), F.avg(share(F.col("h"), F.col("p"))).alias("precision"),
        F.avg(share(F.col("h"), F.col("a"))).alias("recall"),
        F.avg(share(F.lit(2.0) * F.col("h"), F.col("a") + F.col("p"))).alias("f1_score"))
