"""Walk-forward folds, per-fold splits, weights and regimes."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.config import FoldSettings
from tickerloom.functions.scan import most_frequent, sorted_scan
from tickerloom.schemas import FOLDS
from tickerloom.session import stored


@dataclass(frozen=True)
class Fold:
    fold: int
    train_start: date
    train_end: date
    test_start: date
    test_end: date


def add_months(day: date, months: int) -> date:
    """Calendar month addition, clipped to the month's last day."""
    month = day.month - 1 + months
    year, month = day.year + month // 12, month % 12 + 1
    return date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def generate_folds(start: date, end: date, settings: FoldSettings = FoldSettings()) -> list[Fold]:
    """Expanding train ranges. Months are added step by step, so a day clipped once stays clipped."""
    folds: list[Fold] = []
    train_end = add_months(start, settings.initial_train_months)
    while True:
        test_start = train_end + timedelta(days=1)
        if test_start >= end:
            return folds
        test_end = min(add_months(test_start, settings.test_months) - timedelta(days=1), end)
        folds.append(Fold(len(folds), start, train_end, test_start, test_end))
        train_end = add_months(train_end, settings.step_months)


def data_folds(df: DataFrame, settings: FoldSettings = FoldSettings()) -> list[Fold]:
    """Folds of a table's date range: one row of two dates is fetched."""
    span = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    return generate_folds(span["lo"], span["hi"], settings) if span["lo"] else []


def folds_frame(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    rows = [(f.fold, f.train_start, f.train_end, f.test_start, f.test_end) for f in folds]
    return spark.createDataFrame(rows, FOLDS)


def fold_sizes(assigned: DataFrame, settings: FoldSettings = FoldSettings()) -> DataFrame:
    """Train and test rows per fold with the usable flag (enough of both)."""
    sizes = assigned.groupBy("fold").agg(
        F.count(F.when(F.col("part") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("part") == "test", 1)).alias("n_test"))
    usable = (F.col("n_train") >= settings.min_train_rows) & (F.col("n_test") >= settings.min_test_rows)
    return sizes.withColumn("usable", usable)


def train_valid_split(train: DataFrame, keys: Sequence[str] = ("fold",), fraction: float = 0.2,
                      min_rows: int = 50) -> DataFrame:
    """Marks the last max(int(fraction*n), min_rows) rows in (date, ticker) order as validation.

    Rows are counted per date, the dates are accumulated from the end, and only the one date the cut falls into has its
    tickers ranked; no fold's rows are ever sorted as a whole. The counts and the ranked rows are written, the others are not: they are
    read from ``train`` as often as the result is.
    """
    key = list(keys)
    per_date = train.groupBy(*key, "date").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*key).orderBy(F.col("date").desc())
    whole = Window.partitionBy(*key)
    wanted = F.greatest(F.floor(F.sum("_n").over(whole) * F.lit(fraction)), F.lit(min_rows))
    cut = per_date.select(*key, "date", F.sum("_n").over(later).alias("_upto"), "_n", wanted.alias("_want"))
    cut = cut.select(*key, "date", F.when(F.col("_upto") <= F.col("_want"), F.col("_n"))
                     .otherwise(F.greatest(F.lit(0), F.col("_want") - (F.col("_upto") - F.col("_n")))).alias("_take"),
                     "_n")
    placed = train.join(F.broadcast(stored(cut)), key + ["date"])  # a row for each key and date: bounded by folds and calendar
    partial = placed.where((F.col("_take") > 0) & (F.col("_take") < F.col("_n")))
    ranked = stored(sorted_scan(partial, key + ["date"], ["ticker"], {"_rank": F.lit(1)}))
    full = placed.where((F.col("_take") == 0) | (F.col("_take") == F.col("_n"))).withColumn("_rank", F.col("_n"))
    both = full.unionByName(ranked)
    return both.select(*train.columns, (F.col("_rank") > F.col("_n") - F.col("_take")).alias("is_valid"))


def current_regime(test_regimes: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Most frequent regime over each fold's test dates, smallest on ties."""
    return most_frequent(test_regimes.select(*keys, "date", "regime").distinct(), keys, "regime", "current_regime")


def date_ranks(df: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Dense rank (from 0) of each distinct date; only distinct dates are ordered."""
    days = df.select(*keys, "date").distinct()
    group = Window.partitionBy(*keys)
    return days.select(*keys, "date", (F.row_number().over(group.orderBy("date")) - 1).alias("date_rank"),
                       F.count(F.lit(1)).over(group).alias("n_dates"))


def time_decay_weights(train: DataFrame, alpha: float = 0.997, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """alpha ** (age of the row's date in trading days), scaled to mean one per fold."""
    key = list(keys)
    ranks = date_ranks(train, keys)
    raw = F.pow(F.lit(alpha), F.col("n_dates") - 1 - F.col("date_rank"))
    per_date = train.groupBy(*key, "date").agg(F.count(F.lit(1)).alias("_n")).join(ranks, key + ["date"])
    scale = per_date.groupBy(*key).agg((F.sum(raw * F.col("_n")) / F.sum("_n")).alias("_mean"))
    weights = stored(ranks.join(scale, key).select(*key, "date", (raw / F.col("_mean")).alias("weight")))
    return train.join(F.broadcast(weights), key + ["date"]).select(*train.columns, "weight")  # bounded by folds and calendar


def regime_filter(train: DataFrame, current: DataFrame, keys: Sequence[str] = ("fold",),
                  min_rows: int = 50) -> DataFrame:
    """Rows of the fold's current regime; a fold with fewer than ``min_rows`` of them keeps all its rows.

    The rule has a row for each fold, which the settings bound, and is broadcast: joined by fold, a fold's rows would meet in one task."""
    key = list(keys)
    hits = (train.groupBy(*key, "regime").agg(F.count(F.lit(1)).alias("_hits"))
            .join(F.broadcast(current.withColumnRenamed("current_regime", "regime")), key + ["regime"]))
    rule = stored(current.join(hits.select(*key, "_hits"), key, "left"))
    joined = train.join(F.broadcast(rule), key)
    few = F.coalesce("_hits", F.lit(0)) < min_rows
    return joined.where(few | (F.col("regime") == F.col("current_regime"))).select(*train.columns)
