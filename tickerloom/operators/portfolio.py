"""Equal-weight index, rule-based portfolio and its daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.config import PortfolioSettings
from tickerloom.functions.columns import div
from tickerloom.functions.scan import sorted_scan
from tickerloom.operators.alignment import membership_spans, filter_members, prediction_calendar, prices_for_signals, \
    shares_universe


def equal_weight_index(bars: DataFrame) -> DataFrame:
    return bars.groupBy("date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")],
                                    F.sum("volume").alias("volume"))


def keep_latest_fold(predictions: DataFrame, by: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """Overlapping test windows: the latest fold's row per key, by an aggregate with map-side combine."""
    rest = [c for c in predictions.columns if c not in by and c != "fold"]
    kept = predictions.groupBy(*by).agg(F.max(F.struct("fold", *rest)).alias("_row"))
    return kept.select(*[F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in predictions.columns])


def select_lowest_half(scored: DataFrame, by: str = "trade_date", p: str = "y_proba") -> DataFrame:
    """Flags the max(1, n//2) tickers of each date with the lowest drop probability, by ticker on ties."""
    ranked = sorted_scan(scored, [by], [p, "ticker"], {"_rank": F.lit(1)}, totals=True)
    keep = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_rank_total") / 2))
    return ranked.withColumns({"selected": keep, "n_available": F.col("_rank_total")}).drop("_rank", "_rank_total")


def simulate_portfolio(predictions: DataFrame, prices: DataFrame, changes: DataFrame | None = None,
                       current: DataFrame | None = None, settings: PortfolioSettings = PortfolioSettings()) -> DataFrame:
    """Daily strategy and benchmark return of holding the least endangered half of the available tickers.

    Signals of ``entry_delay`` prediction dates ago trade today. A ticker is available unless it sits on a price limit or
    was not a member; with no shared ticker the universe counts as custom and every predicted ticker is eligible. A price
    missing on either side adds no return but keeps its weight. Every invested day pays the cost; a day without
    available tickers is a zero row; a trade date without any price has no row.
    """
    signals = prices_for_signals(predictions, prices, settings.entry_delay)
    traded = prices.select(F.col("date").alias("trade_date")).distinct()
    days = prediction_calendar(predictions, settings.entry_delay).join(traded, "trade_date", "left_semi")
    if current is not None:
        spans = membership_spans(changes, current) if changes is not None else current.select(
            "ticker", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
            F.lit(1).alias("member"))
        members = filter_members(signals.withColumn("date", F.col("trade_date")), spans).drop("date")
        shared = shares_universe(predictions, current)
        # One of the two branches is empty, decided by the scalar subquery.
        signals = members.where(shared).unionByName(signals.where(~shared))
    on_limit = F.lit(False)
    for c in ("is_limit_up", "is_limit_down"):
        if c in prices.columns:
            on_limit = on_limit | F.coalesce(F.col(c) == 1, F.lit(False))
    available = signals.where(~on_limit).join(F.broadcast(days.select("trade_date")), "trade_date", "left_semi")
    chosen = select_lowest_half(available)
    move = F.coalesce(div("close_today", "close_prev") - 1, F.lit(0.0))
    daily = chosen.groupBy("trade_date").agg(
        F.count(F.when(F.col("selected"), 1)).alias("n_positions"),
        F.sum(F.when(F.col("selected"), move)).alias("_picked"), F.avg(move).alias("benchmark_return"))
    turnover = 2.0 / settings.hold_period
    cost = turnover * (settings.commission + settings.slippage) * 2
    out = days.select("trade_date").join(daily, "trade_date", "left")
    invested = F.col("n_positions").isNotNull()
    return out.select(
        F.col("trade_date").alias("date"),
        F.when(invested, F.col("_picked") / F.col("n_positions") - F.lit(cost)).otherwise(F.lit(0.0)).alias("strategy_return"),
        F.coalesce("benchmark_return", F.lit(0.0)).alias("benchmark_return"),
        F.coalesce("n_positions", F.lit(0)).alias("n_positions"),
        F.when(invested, F.lit(turnover)).otherwise(F.lit(0.0)).alias("turnover"))
