"""Technical, microstructure and flow features of a processed panel.

A feature set is a number of named outputs, each a function of one series' rows. ``build`` reads every series once, in order, by its
task, which the calendar bounds, and computes all sets there over whole columns: a sum that several outputs need is taken once, and the
rows are shuffled once. Every output is shifted by ``lag`` rows at the end, which keeps a row's features free of its own bar.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.config import FeatureSettings, TargetSettings
from tickerloom.functions.columns import div
from tickerloom.functions.series import Held, Series, apply_stages, quotient
from tickerloom.operators.alignment import align_index_returns
from tickerloom.operators.cleaning import STOCKS, feature_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan, executors need no copy of the package


@dataclass
class FeatureSet:
    """Outputs as functions of a series' rows. ``extra_lag`` shifts single outputs further than the common lag."""

    outputs: dict[str, Callable[[Held], np.ndarray]]
    extra_lag: dict[str, int] = field(default_factory=dict)


def build(df: DataFrame, sets: Sequence[FeatureSet], lag: int = 1, series: Series = STOCKS, fill: bool = False
          ) -> DataFrame:
    """Adds every output shifted by ``lag``. With ``fill`` a missing value takes the last known one: the newest non-null
    value at least ``lag`` rows back is forward fill and shift."""
    outputs = {name: (of, lag + s.extra_lag.get(name, 0)) for s in sets for name, of in s.outputs.items()}
    order = list(series.order)

    def added(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_start")).combine_chunks()
        rows, columns = Held(table), list(table.columns)
        with np.errstate(all="ignore"):
            for of, back in outputs.values():
                found = of(rows)
                found = rows.lag(rows.filled(found) if fill else found, back)
                columns.append(pa.array(found, pa.float64(), mask=np.isnan(found)))
        return pa.table(columns, names=[*table.column_names, *outputs])

    schema = T.StructType([*df.schema, *(T.StructField(name, T.DoubleType()) for name in outputs)])
    return df.groupBy(*series.keys).applyInArrow(added, schema)


# momentum -------------------------------------------------------------------------------------------------------
def rsi(period: int = 14) -> FeatureSet:
    def of(r: Held) -> np.ndarray:
        change = r.diff("close")
        gain, loss = r.sum("gain", lambda: np.maximum(change, 0.0), period), r.sum("loss", lambda: np.maximum(-change, 0.0), period)
        return 100.0 - 100.0 / (1.0 + quotient(gain, loss))

    return FeatureSet({f"rsi_{period}": of})


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> FeatureSet:
    def line(r: Held) -> np.ndarray:
        return r.once(f"macd {fast} {slow}", lambda: r.ewm("close", None, fast) - r.ewm("close", None, slow))

    def mean(r: Held) -> np.ndarray:
        return r.ewm(f"macd {fast} {slow}", lambda: line(r), signal)

    return FeatureSet({"macd_line": line, "macd_signal": mean, "macd_hist": lambda r: line(r) - mean(r)})


def rate_of_change(periods: Sequence[int] = (5, 10, 20)) -> FeatureSet:
    return FeatureSet({f"roc_{p}": lambda r, p=p: r.change("close", p) for p in periods})


def stochastic_k(period: int = 14) -> FeatureSet:
    def of(r: Held) -> np.ndarray:
        lo, hi = r.extreme("min", "low", period), r.extreme("max", "high", period)
        return 100.0 * quotient(r["close"] - lo, hi - lo)

    return FeatureSet({"stoch_k": of})


# volatility -----------------------------------------------------------------------------------------------------
def _atr(r: Held, period: int) -> np.ndarray:
    def true_range() -> np.ndarray:
        before = r.lag(r["close"], 1)
        # A missing side is left out, so the first row (no previous close) is high - low.
        return np.fmax(np.fmax(r["high"] - r["low"], np.abs(r["high"] - before)), np.abs(r["low"] - before))

    return r.sum("true range", true_range, period) / float(period)


def atr(period: int = 14) -> FeatureSet:
    return FeatureSet({f"atr_{period}": lambda r: _atr(r, period)})


def bollinger_pct_b(period: int = 20, width: float = 2.0) -> FeatureSet:
    def of(r: Held) -> np.ndarray:
        mean, band = r.mean("close", period), width * r.std("close", period)
        return quotient(r["close"] - (mean - band), (mean + band) - (mean - band))

    return FeatureSet({"boll_pctb": of})


def garman_klass_vol(period: int = 20, negative_as_zero: bool = True) -> FeatureSet:
    """``negative_as_zero`` is the fast-mode rule; otherwise a negative mean gives NULL."""
    def daily(r: Held) -> np.ndarray:
        spread, body = (np.log(np.where(x > 0, x, np.nan)) for x in (quotient(r["high"], r["low"]), quotient(r["close"], r["open"])))
        return 0.5 * spread * spread - (2.0 * math.log(2.0) - 1.0) * body * body

    def of(r: Held) -> np.ndarray:
        mean = r.sum("garman klass", lambda: daily(r), period) / float(period)
        return np.sqrt(np.maximum(mean, 0.0) if negative_as_zero else np.where(mean >= 0, mean, np.nan))

    return FeatureSet({"gk_vol": of})


def realized_vol(period: int = 20) -> FeatureSet:
    return FeatureSet({f"realized_vol_{period}": lambda r: r.std("returns", period)})


# volume ---------------------------------------------------------------------------------------------------------
def obv_z(period: int = 60, min_periods: int = 20) -> FeatureSet:
    def of(r: Held) -> np.ndarray:
        signed = np.sign(r.diff("close")) * r["volume"]
        total = np.where(np.isnan(signed), np.nan, np.cumsum(np.nan_to_num(signed, nan=0.0)))
        r.held["obv"] = total
        return quotient(total - r.known_mean("obv", period, min_periods), r.std("obv", period, min_periods))

    return FeatureSet({"obv_z": of})


def volume_ma_ratio(period: int = 20) -> FeatureSet:
    return FeatureSet({"vol_ma_ratio": lambda r: quotient(r["volume"], r.mean("volume", period))})


def vwap_ratio(period: int = 20) -> FeatureSet:
    def of(r: Held) -> np.ndarray:
        money = r.sum("money", lambda: (r["high"] + r["low"] + r["close"]) / 3.0 * r["volume"], period)
        return quotient(r["close"], quotient(money, r.sum("volume", None, period)))

    return FeatureSet({"vwap_ratio": of})


# trend ----------------------------------------------------------------------------------------------------------
def ema(spans: Sequence[int] = (20, 50, 200)) -> FeatureSet:
    return FeatureSet({f"ema_{s}": lambda r, s=s: r.ewm("close", None, s) for s in spans})


def ema_cross(pairs: Sequence[tuple[int, int]] = ((20, 50), (50, 200))) -> FeatureSet:
    return FeatureSet({f"ema_cross_{f}_{s}": lambda r, f=f, s=s: quotient(r.ewm("close", None, f) - r.ewm("close", None, s), r["close"]) for f, s in pairs})


def adx(period: int = 14) -> FeatureSet:
    def index(r: Held) -> np.ndarray:
        up, down = (np.where(d > 0, d, np.where(np.isnan(d), np.nan, 0.0)) for d in (r.diff("high"), -r.diff("low")))
        # The first row has no difference: its comparison is not true, so plus becomes 0 while minus stays NULL.
        plus = r.sum("plus", lambda: np.where(up > down, up, 0.0), period)
        minus = r.sum("minus", lambda: np.where(up > down, 0.0, down), period)
        plus, minus = ((100.0 / period) * quotient(x, _atr(r, period)) for x in (plus, minus))
        return 100.0 * quotient(np.abs(plus - minus), plus + minus)

    return FeatureSet({f"adx_{period}": lambda r: r.sum(f"dx {period}", lambda: index(r), period) / float(period)})


# mean reversion -------------------------------------------------------------------------------------------------
def zscore_vs_ma(periods: Sequence[int] = (20, 60)) -> FeatureSet:
    return FeatureSet({f"zscore_{p}": lambda r, p=p: quotient(r["close"] - r.mean("close", p), r.std("close", p)) for p in periods})


def distance_from_extremes(period: int = 252, min_periods: int = 60) -> FeatureSet:
    def of(how: str) -> Callable[[Held], np.ndarray]:
        return lambda r: quotient(r["close"] - r.extreme(how, "close", period, min_periods), r.extreme(how, "close", period, min_periods))

    return FeatureSet({"dist_52w_high": of("max"), "dist_52w_low": of("min")})


def lagged_returns(days: Sequence[int] = (1, 2, 3, 5, 10, 20)) -> FeatureSet:
    names = {f"ret_lag_{d}": d - 1 for d in days}
    return FeatureSet({n: lambda r: r["returns"] for n in names}, names)


# microstructure -------------------------------------------------------------------------------------------------
def limit_proximity(limit_pct: float = 0.07) -> FeatureSet:
    def of(r: Held) -> np.ndarray:
        floor, ceiling = r["ref_price"] * (1.0 - limit_pct), r["ref_price"] * (1.0 + limit_pct)
        return quotient(r["close"] - floor, ceiling - floor)

    return FeatureSet({"cb_proximity": of})


def _hits(r: Held, window: int) -> np.ndarray:
    return r.sum("hits", lambda: r["is_limit_up"] + r["is_limit_down"], window, 0.0)


def limit_hit_count(windows: Sequence[int] = (5, 10)) -> FeatureSet:
    return FeatureSet({f"limit_hit_{w}d": lambda r, w=w: _hits(r, w) for w in windows})


def limit_direction_ratio(window: int = 10) -> FeatureSet:
    return FeatureSet({f"limit_dir_ratio_{window}d": lambda r: quotient(r.sum("is_limit_up", None, window, 0.0), _hits(r, window))})


def intraday_range_ratio(limit_pct: float = 0.07) -> FeatureSet:
    return FeatureSet({"intraday_range_ratio": lambda r: quotient(r["high"] - r["low"], 2.0 * limit_pct * r["ref_price"])})


def close_in_range() -> FeatureSet:
    return FeatureSet({"close_in_range": lambda r: quotient(r["close"] - r["low"], r["high"] - r["low"])})


# flow -----------------------------------------------------------------------------------------------------------
def flow_proxy(name: str, z_period: int, mean_period: int, min_periods: int) -> FeatureSet:
    """Volume z-score signed by the day's move, then averaged."""
    def signed(r: Held) -> np.ndarray:
        return r.once(f"signed {z_period}", lambda: quotient(r["volume"] - r.mean("volume", z_period), r.std("volume", z_period)) * np.sign(r.change("close", 1)))

    def of(r: Held) -> np.ndarray:
        # Shorter histories count: rows before the series and NULL rows enter as 0 and are left out of the count.
        value = r.sum(f"signed {z_period} or 0", lambda: np.nan_to_num(signed(r), nan=0.0, posinf=math.inf, neginf=-math.inf), mean_period, 0.0)
        count = r.sum(f"signed {z_period} known", lambda: 1.0 - np.isnan(signed(r)), mean_period, 0.0)
        return np.where(count >= min_periods, quotient(value, count), np.nan)

    return FeatureSet({name: of})


def flow_proxies(mode: str = "full") -> list[FeatureSet]:
    if mode == "fast":
        return [flow_proxy("ff_proxy_vol_20", 20, 20, 5), flow_proxy("ff_proxy_vol_60", 20, 60, 10)]
    return [flow_proxy("ff_proxy_vol_20", 20, 20, 5), flow_proxy("ff_proxy_vol_60", 60, 60, 5)]


def index_correlation(periods: Sequence[int] = (20, 60), min_periods: int = 10) -> FeatureSet:
    """Needs ``index_returns`` on the panel (``align_index_returns``)."""
    return FeatureSet({f"index_corr_{p}": lambda r, p=p: r.correlation("returns", "index_returns", p, min_periods) for p in periods})


# groups ---------------------------------------------------------------------------------------------------------
def technical_sets(mode: str = "full") -> list[FeatureSet]:
    return [
        rsi(), macd(), rate_of_change(), stochastic_k(), atr(), bollinger_pct_b(),
        garman_klass_vol(negative_as_zero=mode == "fast"), realized_vol(), obv_z(), volume_ma_ratio(),
        vwap_ratio(), ema(), ema_cross(), adx(), zscore_vs_ma(), distance_from_extremes(),
        lagged_returns(),
    ]


def microstructure_sets(limit_pct: float = 0.07) -> list[FeatureSet]:
    return [limit_proximity(limit_pct), limit_hit_count(), limit_direction_ratio(),
            intraday_range_ratio(limit_pct), close_in_range()]


def technical_features(df: DataFrame, lag: int = 1, mode: str = "full") -> DataFrame:
    return build(df, technical_sets(mode), lag)


def microstructure_features(df: DataFrame, lag: int = 1, limit_pct: float = 0.07) -> DataFrame:
    return build(df, microstructure_sets(limit_pct), lag)


def flow_features(df: DataFrame, index_bars: DataFrame | None = None, lag: int = 1, mode: str = "full") -> DataFrame:
    sets = flow_proxies(mode)
    if index_bars is None or mode == "fast":
        return build(df, sets, lag)
    return build(align_index_returns(df, index_bars), sets + [index_correlation()], lag).drop("index_returns")


def with_target(df: DataFrame, horizon: int = 3, threshold: float = -0.015, k: Series = STOCKS) -> DataFrame:
    """Forward return over ``horizon`` rows and the drop label; an unknown return is labelled 0."""
    out = apply_stages(df, [{"fwd_return": div(k.shift("close", -horizon), "close") - 1}])
    return out.withColumn("label", F.when(F.col("fwd_return") < threshold, 1).otherwise(0))


def lookback_sequences(df: DataFrame, values: Sequence, n: int = 20, k: Series = STOCKS) -> DataFrame:
    """Adds ``sequence``: the feature vectors of the ``n`` rows before each row, oldest first. Rows with a shorter history
    are left out. ``values`` are columns or names."""
    vector = F.array(*[(F.col(v) if isinstance(v, str) else v).cast("double") for v in values])
    out = df.withColumn("sequence", k.lookback(vector, n))
    return out.where(F.size("sequence") == n)


def build_feature_matrix(bars: DataFrame, index_bars: DataFrame | None = None,
                         features: FeatureSettings = FeatureSettings(), target: TargetSettings = TargetSettings(),
                         keep_tail: bool = False, as_float: bool = False) -> DataFrame:
    """Features, target, forward fill, and only complete rows, as one plan.

    The last ``horizon`` rows of a ticker have no label and are dropped; ``keep_tail`` keeps them with label 0.
    """
    k, mode = STOCKS, features.mode
    sets = technical_sets(mode) + microstructure_sets(features.limit_pct) + flow_proxies(mode)
    panel = bars
    if index_bars is not None and mode == "full":
        panel = align_index_returns(panel, index_bars)
        sets.append(index_correlation(min_periods=features.corr_min_periods))
    # The target comes first and travels along, so the wide rows of features pass no window.
    # Filled before the tail is cut: a fill only looks back, so the order of the two does not matter.
    targeted = with_target(panel, target.horizon, target.drop_threshold, k)
    matrix = build(targeted, sets, features.min_lag, k, fill=True).drop("index_returns")
    names = feature_columns(matrix)
    kept = matrix if keep_tail else matrix.where(F.col("fwd_return").isNotNull())
    complete = kept.dropna(subset=names)
    if as_float:
        complete = complete.withColumns({n: F.col(n).cast("float") for n in names})
    return complete
