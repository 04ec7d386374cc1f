"""Immutable settings. ``None`` is the only marker for "use the default"."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureSettings:
    min_lag: int = 1
    limit_pct: float = 0.07
    limit_tolerance: float = 0.002
    corr_min_periods: int = 10
    mode: str = "full"


@dataclass(frozen=True)
class TargetSettings:
    horizon: int = 3
    drop_threshold: float = -0.015


@dataclass(frozen=True)
class RegimeSettings:
    n_states: int = 3
    min_train_rows: int = 252
    refit_interval: int = 60
    em_iterations: int = 100
    em_tolerance: float = 1e-3
    changepoint_min_size: int = 20
    changepoint_penalty: float = 10.0
    trend_span: int = 200
    vol_window: int = 60
    vol_percentile: float = 80.0
    override_below_prob: float = 0.7


@dataclass(frozen=True)
class FoldSettings:
    initial_train_months: int = 60
    test_months: int = 6
    step_months: int = 3
    min_train_rows: int = 100
    min_test_rows: int = 20
    valid_fraction: float = 0.2
    min_valid_rows: int = 50
    purge_days: int = 0


QUICK_FOLDS = FoldSettings(initial_train_months=36, test_months=6, step_months=6)


@dataclass(frozen=True)
class ModelSettings:
    max_depth: int = 7
    step_size: float = 0.05
    max_rounds: int = 1000
    patience: int = 50
    max_leaves: int = 63
    min_leaf_rows: int = 50
    l1: float = 10.0
    l2: float = 50.0
    subsample: float = 0.8
    column_share: float = 0.8
    fine_tune_rounds: int = 80
    fine_tune_step: float = 0.02
    forest_trees: int = 100
    decay_alpha: float = 0.997
    min_regime_rows: int = 50
    weight_base: float = 0.6
    weight_adapted: float = 0.4
    threshold: float = 0.5
    seed: int = 42


@dataclass(frozen=True)
class PortfolioSettings:
    entry_delay: int = 1
    hold_period: int = 3
    commission: float = 0.0015
    slippage: float = 0.001
    trading_days: int = 252


@dataclass(frozen=True)
class StatisticSettings:
    n_bootstrap: int = 10_000
    ci: float = 0.95
    psi_bins: int = 10
    psi_threshold: float = 0.25
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    features: FeatureSettings = field(default_factory=FeatureSettings)
    target: TargetSettings = field(default_factory=TargetSettings)
    regime: RegimeSettings = field(default_factory=RegimeSettings)
    folds: FoldSettings = field(default_factory=FoldSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    portfolio: PortfolioSettings = field(default_factory=PortfolioSettings)
    statistics: StatisticSettings = field(default_factory=StatisticSettings)
