"""Joins that align panels, indices, regimes, memberships and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def align_index_returns(panel: DataFrame, index_bars: DataFrame, out: str = "index_returns",
                        series_id: str | None = None) -> DataFrame:
    """Index return of each row's date. One index has one row per calendar day (36,525 in a century, under 1 MB), so
    broadcasting it is bounded by the calendar, not by the panel. Several series without a ``series_id`` that chooses one are an error:
    a date would match twice."""
    index = index_bars
    if series_id is not None:
        index = index.where(F.col("series_id") == series_id)
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several index rows for a date: choose a series_id")).cast("double")).otherwise(F.first("returns"))
    return panel.join(F.broadcast(index.groupBy("date").agg(one.alias(out))), "date", "left").select(*panel.columns, out)


def merge_regime_sources(states: DataFrame, changepoints: DataFrame, rules: DataFrame) -> DataFrame:
    keys = ["series_id", "date"]
    return states.join(changepoints, keys, "full_outer").join(rules, keys, "full_outer")


def regime_for_dates(regime: DataFrame, dates: DataFrame, asof: bool = False) -> DataFrame:
    """Regime per requested date of one series: exact match, then carried along the requested dates, then sideways (1).

    ``asof`` also carries regimes of dates that were not requested. Both sides hold one row per calendar day.
    """
    wanted = dates.select("date").distinct()
    if asof:
        joined = wanted.withColumn("_want", F.lit(True)).join(regime.select("date", "regime"), "date", "full_outer")
    else:
        joined = wanted.withColumn("_want", F.lit(True)).join(regime.select("date", "regime"), "date", "left")
    line = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    carried = joined.withColumn("regime", F.last("regime", ignorenulls=True).over(line))
    return carried.where("_want").select("date", F.coalesce("regime", F.lit(1)).cast("int").alias("regime"))


def membership_spans(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Half-open date spans [valid_from, valid_to) with a member flag per ticker.

    A date is decided by the earliest change after it: before an addition the ticker was out, before a removal it was in;
    after the last change the current list holds. Spans per ticker replace a comparison of every date with every change.
    If one ticker has both actions on a date, the removal is undone last and wins.
    """
    decided = changes.groupBy("ticker", F.col("date").alias("valid_to")).agg(
        F.max(F.when(F.col("action") == "removed", 1).otherwise(0)).alias("member"))
    by_ticker = Window.partitionBy("ticker").orderBy("valid_to")
    past = decided.select("ticker", F.lag("valid_to").over(by_ticker).alias("valid_from"), "valid_to", "member")
    last_change = decided.groupBy("ticker").agg(F.max("valid_to").alias("valid_from"))
    now = current.select("ticker").distinct().withColumn("_current", F.lit(1))
    tail = last_change.join(now, "ticker", "full_outer").select(
        "ticker", "valid_from", F.lit(None).cast("date").alias("valid_to"),
        F.coalesce("_current", F.lit(0)).alias("member"))
    return past.unionByName(tail)


def _within(date: Column) -> Column:
    return ((F.col("valid_from").isNull() | (date >= F.col("valid_from")))
            & (F.col("valid_to").isNull() | (date < F.col("valid_to"))))


def filter_members(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows whose ticker was a member on the row's date: an equi-join on ticker with a span condition."""
    inside = spans.where("member = 1").select(F.col("ticker").alias("_t"), "valid_from", "valid_to")
    return panel.join(inside, (F.col("ticker") == F.col("_t")) & _within(F.col("date")), "left_semi")


def members_on(spans: DataFrame, date) -> DataFrame:
    day = F.lit(date).cast("date")
    return spans.where((F.col("member") == 1) & _within(day)).select(day.alias("date"), "ticker")


def all_historical_members(changes: DataFrame, current: DataFrame) -> DataFrame:
    removed = changes.where(F.col("action") == "removed").select("ticker")
    return current.select("ticker").union(removed).distinct()


def shares_universe(predictions: DataFrame, current: DataFrame) -> Column:
    """Scalar subquery: does any predicted ticker belong to the current list? If none does, the universe is custom."""
    overlap = predictions.select("ticker").join(current.select("ticker"), "ticker", "left_semi")
    return overlap.agg((F.count(F.lit(1)) > 0).alias("shared")).scalar()


def common_tickers(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("ticker").intersect(right.select("ticker"))


def regime_confidence(regime: DataFrame, test_dates: DataFrame, keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Mean state probability over the regime rows dated in each fold's test set, 0.5 where there is none."""
    asked = test_dates.select(*keys, "date").distinct()
    joined = asked.join(regime.select("date", "state_prob"), "date", "left")
    return joined.groupBy(*keys).agg(F.coalesce(F.avg("state_prob"), F.lit(0.5)).alias("confidence"))


def prediction_calendar(predictions: DataFrame, entry_delay: int = 1) -> DataFrame:
    """Trade dates with the signal date ``entry_delay`` positions earlier and the previous prediction date. Distinct
    dates only, so the single ordered group is bounded by the calendar."""
    line = Window.orderBy("date")
    days = predictions.select("date").distinct()
    calendar = days.select(F.col("date").alias("trade_date"), F.lag("date", entry_delay).over(line).alias("signal_date"),
                           F.lag("date", 1).over(line).alias("prev_date"))
    return calendar.where(F.col("signal_date").isNotNull()).select(
        "trade_date", "signal_date", F.coalesce("prev_date", "trade_date").alias("prev_date"))


def prices_for_signals(predictions: DataFrame, prices: DataFrame, entry_delay: int = 1) -> DataFrame:
    """Each prediction with the trade-date price and flags and the close at the previous prediction date."""
    calendar = F.broadcast(prediction_calendar(predictions, entry_delay))
    signals = predictions.join(calendar, predictions["date"] == calendar["signal_date"]).select(
        "trade_date", "prev_date", "signal_date", "ticker", "y_proba")
    flags = [c for c in ("is_limit_up", "is_limit_down") if c in prices.columns]
    today = prices.select(F.col("date").alias("trade_date"), "ticker", F.col("close").alias("close_today"), *flags)
    before = prices.select(F.col("date").alias("prev_date"), "ticker", F.col("close").alias("close_prev"))
    return signals.join(today, ["trade_date", "ticker"], "left").join(before, ["prev_date", "ticker"], "left")


def assign_folds(df: DataFrame, folds: Sequence, part: str = "both") -> DataFrame:
    """Rows tagged with every fold whose train or test range holds their date.

    Folds are few (the calendar divided by the step), known before the job, and enter as a literal array: the range join
    becomes a projection without any join.
    """
    pieces = []
    for f in folds:
        for name, lo, hi in (("train", f.train_start, f.train_end), ("test", f.test_start, f.test_end)):
            if part in ("both", name):
                inside = F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
                pieces.append(F.when(inside, F.struct(F.lit(f.fold).alias("fold"), F.lit(name).alias("part"))))
    tagged = df.withColumn("_f", F.explode(F.array_compact(F.array(*pieces))))
    return tagged.select(*df.columns, "_f.fold", "_f.part")


