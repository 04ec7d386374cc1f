"""Market regimes of index series: trend and volatility rules, mixture states, mean shifts, and their combination.

Index series hold one row per calendar day, so a whole series is a small window group; many series run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.config import RegimeSettings
from tickerloom.functions.columns import div
from tickerloom.functions.series import Series, apply_stages, expanding_pct_rank, with_ewm
from tickerloom.operators.alignment import merge_regime_sources
from tickerloom.operators.cleaning import INDICES
from tickerloom.session import stored

BULL, SIDEWAYS, BEAR = 0, 1, 2
REGIME_NAMES = {BULL: "Bull", SIDEWAYS: "Sideways", BEAR: "Bear"}


def ema_trend(index: DataFrame, span: int = 200, k: Series = INDICES) -> DataFrame:
    """Above its long mean: 0, otherwise 2."""
    smoothed = with_ewm(index, "close", [span], k, "_trend")
    above = F.col("close") > F.col(f"_trend_{span}")
    return smoothed.withColumn("trend", F.when(above, BULL).otherwise(BEAR)).drop(f"_trend_{span}")


def volatility_flag(index: DataFrame, window: int = 60, percentile: float = 80.0, k: Series = INDICES) -> DataFrame:
    """1 when recent volatility ranks above the percentile of its own history."""
    vol = apply_stages(index, [{"_vol": k.rolling("std", "returns", window, 20)}])
    # Rank and minimum length count the days that have a volatility.
    ranked = expanding_pct_rank(vol, "_vol", "_rank", 60, k)
    return ranked.withColumn("vol_high", F.when(F.col("_rank") > percentile / 100.0, 1).otherwise(0)).drop("_vol", "_rank")


def rule_regime(index: DataFrame, settings: RegimeSettings = RegimeSettings(), k: Series = INDICES) -> DataFrame:
    both = volatility_flag(ema_trend(index, settings.trend_span, k), settings.vol_window, settings.vol_percentile, k)
    rule = (F.when((F.col("trend") == BULL) & (F.col("vol_high") == 0), BULL)
            .when((F.col("trend") == BEAR) & (F.col("vol_high") == 1), BEAR).otherwise(SIDEWAYS))
    return both.withColumn("rule_regime", rule)


def _numbered(index: DataFrame, value_columns: list[str], k: Series) -> DataFrame:
    return index.select(*k.keys, "date", *value_columns).withColumn("_pos", k.row_number() - 1)


def refit_blocks(numbered: DataFrame, start: int, step: int, k: Series = INDICES) -> DataFrame:
    """One row per (series, block): rows from block_start up to the next one are judged by a fit on the rows before."""
    sizes = numbered.groupBy(*k.keys).agg((F.max("_pos") + 1).alias("_n")).where(F.col("_n") > start)
    starts = sizes.withColumn("block_start", F.explode(F.sequence(F.lit(start), F.col("_n") - 1, F.lit(step))))
    return starts.select(*k.keys, "block_start")


def _own_block(settings: RegimeSettings) -> Column:
    """Start of the block a row is judged in; NULL before the first fit."""
    start, step = settings.min_train_rows, settings.refit_interval
    return F.when(F.col("_pos") >= start, (F.lit(start) + F.floor((F.col("_pos") - start) / step) * step).cast("int"))


# mixture states -------------------------------------------------------------------------------------------------
def _log_density(params: Column, x: Column, y: Column) -> Column:
    """Weighted bivariate normal log density, up to the constant all components share."""
    det = params["vxx"] * params["vyy"] - params["vxy"] * params["vxy"]
    dx, dy = x - params["mx"], y - params["my"]
    quad = (params["vyy"] * dx * dx - F.lit(2.0) * params["vxy"] * dx * dy + params["vxx"] * dy * dy) / det
    return F.ln(params["w"]) - F.lit(0.5) * F.ln(det) - F.lit(0.5) * quad


def _responsibilities(k_states: int) -> list[Column]:
    return _likelihood(k_states)[0]


def _likelihood(k_states: int) -> tuple[list[Column], Column]:
    """Each component's share of a row, and the row's log-likelihood up to a constant."""
    logs = [_log_density(F.col(f"c{i}"), F.col("x"), F.col("y")) for i in range(k_states)]
    top = F.greatest(*logs)
    weights = [F.exp(v - top) for v in logs]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    return [w / total for w in weights], top + F.ln(total)


# Keeps a component that holds almost no row from collapsing to zero variance.
MIN_VARIANCE = 1e-8
MIN_WEIGHT = 1e-6


def _maximise(weighted: DataFrame, group: list[str], k_states: int) -> DataFrame:
    """Component parameters from responsibilities r0..rk: one grouped sum for all series and blocks."""
    sums = [F.count(F.lit(1)).alias("n"), F.avg("ll").alias("ll")]
    for i in range(k_states):
        r = F.col(f"r{i}")
        sums += [F.sum(r).alias(f"s{i}"), F.sum(r * F.col("x")).alias(f"sx{i}"), F.sum(r * F.col("y")).alias(f"sy{i}"),
                 F.sum(r * F.col("x") * F.col("x")).alias(f"sxx{i}"), F.sum(r * F.col("y") * F.col("y")).alias(f"syy{i}"),
                 F.sum(r * F.col("x") * F.col("y")).alias(f"sxy{i}")]
    agg = weighted.groupBy(*group).agg(*sums)
    components = []
    for i in range(k_states):
        mass = F.greatest(F.col(f"s{i}"), F.lit(MIN_WEIGHT))
        mx, my = F.col(f"sx{i}") / mass, F.col(f"sy{i}") / mass
        components.append(F.struct(
            F.greatest(F.col(f"s{i}") / F.col("n"), F.lit(MIN_WEIGHT)).alias("w"), mx.alias("mx"), my.alias("my"),
            F.greatest(F.col(f"sxx{i}") / mass - mx * mx, F.lit(MIN_VARIANCE)).alias("vxx"),
            F.greatest(F.col(f"syy{i}") / mass - my * my, F.lit(MIN_VARIANCE)).alias("vyy"),
            (F.col(f"sxy{i}") / mass - mx * my).alias("vxy")).alias(f"c{i}"))
    return agg.select(*group, "ll", *components)


def mixture_observations(index: DataFrame, k: Series = INDICES) -> DataFrame:
    """Returns and 20-row volatility, scaled to per-cent so variances stay far from the floor."""
    rows = index.where(F.col("returns").isNotNull())
    vol = apply_stages(rows, [{"_vol": k.rolling("std", "returns", 20, 10)}]).where(F.col("_vol").isNotNull())
    return _numbered(vol.select(*k.keys, "date", (F.col("returns") * 100).alias("x"), (F.col("_vol") * 100).alias("y")),
                     ["x", "y"], k)


def mixture_state(index: DataFrame, settings: RegimeSettings = RegimeSettings(), k: Series = INDICES) -> DataFrame:
    """State and its probability per day from a Gaussian mixture refitted on the past every ``refit_interval`` rows.

    All series and refits are fitted together: an EM step is one join of rows with parameters and one grouped sum, whose few rows are
    written; steps end when no fit's mean log-likelihood rises by ``em_tolerance``. A fit
    sees only rows before its block, states are ranked by mean return within the fit (0 = highest), and each row is
    scored by its own block's fit, so nothing later than a row can move its state.
    """
    n = settings.n_states
    group = [*k.keys, "block_start"]
    rows = mixture_observations(index, k)
    blocks = refit_blocks(rows, settings.min_train_rows, settings.refit_interval, k)
    train = stored(rows.join(blocks, list(k.keys)).where(F.col("_pos") < F.col("block_start")).select(*group, "x", "y"))
    # Start: thirds of the return distribution, by the cut points of each fit's own rows.
    cuts = train.groupBy(*group).agg(F.percentile("x", [i / n for i in range(1, n)]).alias("_cuts"))
    third = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col("x")))
    started = train.join(cuts, group).select(
        *group, "x", "y", *[F.when(third == i, 1.0).otherwise(0.0).alias(f"r{i}") for i in range(n)], F.lit(None).cast("double").alias("ll"))
    params = stored(_maximise(started, group, n))
    shares, ll = _likelihood(n)
    for _ in range(settings.em_iterations):
        scored = train.join(params.drop("ll"), group)
        scored = scored.select(*group, "x", "y", *[r.alias(f"r{i}") for i, r in enumerate(shares)], ll.alias("ll"))
        before, params = params, stored(_maximise(scored, group, n))
        gained = params.join(before.select(*group, F.col("ll").alias("_ll")), group).agg(F.max(F.col("ll") - F.col("_ll"))).first()[0]
        if gained is not None and gained < settings.em_tolerance:
            break
    ordered = relabel_by_return(params, group, n)
    judged = rows.withColumn("block_start", _own_block(settings)).join(ordered, group)
    probs = judged.select(*k.keys, "date", *[r.alias(f"p{i}") for i, r in enumerate(_responsibilities(n))])
    best = F.greatest(*[F.col(f"p{i}") for i in range(n)])
    state = F.lit(n - 1)
    for i in reversed(range(n - 1)):
        state = F.when(F.col(f"p{i}") == best, i).otherwise(state)
    return probs.select(*k.keys, "date", state.cast("int").alias("state"), best.alias("state_prob"))


def relabel_by_return(params: DataFrame, group: list[str], n_states: int = 3) -> DataFrame:
    """Reorders components so that c0 has the highest mean return; a sort inside each row."""
    array = F.array(*[F.struct((-F.col(f"c{i}.mx")).alias("_key"), F.col(f"c{i}").alias("c")) for i in range(n_states)])
    ordered = F.sort_array(array)
    return params.select(*group, *[ordered[i]["c"].alias(f"c{i}") for i in range(n_states)])


# mean shifts ----------------------------------------------------------------------------------------------------
def changepoints(index: DataFrame, settings: RegimeSettings = RegimeSettings(), k: Series = INDICES) -> DataFrame:
    """Mean-shift breaks of returns by binary segmentation, refitted on the past every ``refit_interval`` rows.

    A break at b splits [a, c) and removes gain = cost(a,c) - cost(a,b) - cost(b,c) of squared deviation. Segments of all
    series and refits are split together, level by level, until no gain exceeds the penalty. The loop's state is the segments
    that the last level made; prefix sums are written once and a level is one grouped maximum over them. Rows before the
    first fit are 0.
    """
    keys = list(k.keys)
    rows = _numbered(index.where(F.col("returns").isNotNull()), ["returns"], k)
    sums = stored(apply_stages(rows, [{"_s": F.sum("returns").over(k.history)}]).select(*keys, "date", "_pos", "_s"))
    blocks = refit_blocks(sums, settings.min_train_rows, settings.refit_interval, k)
    fit = [*keys, "block_start"]
    # Prefix value P(b) = sum of the first b returns belongs to candidate b = _pos + 1.
    prefix = sums.select(*keys, (F.col("_pos") + 1).alias("b"), F.col("_s").alias("pb"))
    segments = blocks.join(prefix, keys).where(F.col("b") == F.col("block_start")).select(
        *fit, F.lit(0).alias("a"), F.lit(0.0).alias("pa"), F.col("block_start").alias("c"), F.col("pb").alias("pc"))
    left, right = F.col("b") - F.col("a"), F.col("c") - F.col("b")
    # Sum-of-squares terms cancel: the gain is the between-group part.
    gain = (F.pow(F.col("pb") - F.col("pa"), 2) / left + F.pow(F.col("pc") - F.col("pb"), 2) / right
            - F.pow(F.col("pc") - F.col("pa"), 2) / (F.col("c") - F.col("a")))
    found = None
    while True:
        allowed = (left >= settings.changepoint_min_size) & (right >= settings.changepoint_min_size)
        scored = segments.join(prefix, keys).where(allowed).withColumn("_gain", gain)
        best = stored(scored.groupBy(*fit, "a", "pa", "c", "pc").agg(F.max(F.struct("_gain", (-F.col("b")).alias("nb"), "pb")).alias("_m"))
                      .where(F.col("_m._gain") > settings.changepoint_penalty)
                      .select(*fit, "a", "pa", "c", "pc", (-F.col("_m.nb")).alias("cut"), F.col("_m.pb").alias("pcut")))
        cuts = best.select(*fit, "cut")
        found = cuts if found is None else found.unionByName(cuts)
        if best.isEmpty():
            break
        segments = best.select(*fit, "a", "pa", F.col("cut").alias("c"), F.col("pcut").alias("pc")).unionByName(
            best.select(*fit, F.col("cut").alias("a"), F.col("pcut").alias("pa"), "c", "pc"))
    # Breaks lie before the block they serve (the fit is on the past), so a block's last break is one value per fit.
    return flag_changes(sums, found.groupBy(*fit).agg(F.max("cut").alias("_last")), settings, k)


def flag_changes(rows: DataFrame, last: DataFrame, settings: RegimeSettings, k: Series = INDICES) -> DataFrame:
    """(series, date, cp_flag, days_since_cp) of numbered rows, given the ``_last`` break of each block's fit: a break is flagged on the
    first day of the block whose fit first shows it."""
    keys = list(k.keys)
    fit = [*keys, "block_start"]
    out = rows.withColumn("block_start", _own_block(settings)).join(last, fit, "left")
    start = F.lit(settings.min_train_rows)
    since = (F.when(F.col("_pos") < start, F.lit(0.0))
             .otherwise((F.col("_pos") - F.coalesce("_last", start)).cast("double")))
    first_seen = (F.col("_pos") >= start) & (F.col("_pos") == F.col("block_start")) & F.col("_new")
    before_block = Window.partitionBy(*keys).orderBy("block_start")
    news = last.select(*fit, F.coalesce(F.col("_last") != F.lag("_last").over(before_block), F.lit(True)).alias("_new"))
    out = out.join(news, fit, "left")
    return out.select(*keys, "date", F.when(first_seen, 1).otherwise(0).alias("cp_flag"), since.alias("days_since_cp"))


# combination ----------------------------------------------------------------------------------------------------
def hybrid_regime(states: DataFrame, changes: DataFrame, rules: DataFrame, below: float = 0.7) -> DataFrame:
    """Mixture state, overridden by a bull or bear rule where the state is missing or unsure; sideways if unknown."""
    merged = merge_regime_sources(states, changes, rules)
    unsure = F.col("state").isNull() | (F.col("state_prob") < below)
    regime = (F.when((F.col("rule_regime") == BULL) & unsure, BULL).when((F.col("rule_regime") == BEAR) & unsure, BEAR)
              .otherwise(F.coalesce(F.col("state"), F.lit(SIDEWAYS))))
    return merged.withColumn("regime", regime.cast("int"))


def detect_regime(index: DataFrame, settings: RegimeSettings = RegimeSettings(), k: Series = INDICES) -> DataFrame:
    """Hidden Markov states, mean shifts of least cost and the rules, combined."""
    from tickerloom.operators.markov import markov_state  # both build on this module
    from tickerloom.operators.segmentation import optimal_changepoints

    rules = rule_regime(index, settings, k).select(*k.keys, "date", "rule_regime")
    return hybrid_regime(markov_state(index, settings, k), optimal_changepoints(index, settings, k), rules,
                         settings.override_below_prob)


def regime_shift_flag(regime: DataFrame, lookback: int = 5, k: Series = INDICES) -> DataFrame:
    out = apply_stages(regime, [{"_mode": k.rolling_mode("regime", lookback, (BULL, SIDEWAYS, BEAR))}])
    return out.withColumn("shift_flag", (F.col("regime") != F.col("_mode")).cast("int")).drop("_mode")


def regime_runs(regime: DataFrame, k: Series = INDICES) -> DataFrame:
    """Contiguous stretches of one regime: start, end and length in rows."""
    changed = F.when(F.col("regime") == k.shift("regime"), 0).otherwise(1)
    runs = apply_stages(regime.select(*k.keys, "date", "regime"),
                        [{"_changed": changed}, {"run": F.sum("_changed").over(k.history)}])
    return runs.groupBy(*k.keys, "run", "regime").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("n_rows"))
