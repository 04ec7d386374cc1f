"""Significance tests, bootstrap intervals, drift and leakage measures."""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.columns import div, hash_uniform, normal_cdf, poisson_one
from tickerloom.functions.scan import sorted_scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan, executors need no copy of the package

LOSS_NAMES = {"brier": "brier", "squared": "brier", "logloss": "logloss", "absolute": "absolute"}


def forecast_loss(actual: Column, predicted: Column, loss: str) -> Column:
    if loss not in LOSS_NAMES:
        raise ValueError(f"unknown loss {loss!r}: use brier, squared, logloss or absolute")
    if LOSS_NAMES[loss] == "brier":
        return (actual - predicted) * (actual - predicted)
    if loss == "absolute":
        return F.abs(actual - predicted)
    p = F.greatest(F.least(predicted, F.lit(1 - 1e-15)), F.lit(1e-15))
    return -(actual * F.ln(p) + (F.lit(1.0) - actual) * F.ln(F.lit(1.0) - p))


def _lagged_covariances(d: DataFrame, keys: Sequence[str], order: Sequence[str], h: int) -> DataFrame:
    """Sum over k < h of cov(d_t, d_{t-k}): rows are numbered by a distributed scan and joined to the row k before."""
    numbered = sorted_scan(d.select(*keys, *order, "d"), keys, order, {"_pos": F.lit(1)}).select(*keys, "_pos", "d")
    total = None
    for k in range(1, h):
        earlier = numbered.select(*keys, (F.col("_pos") + k).alias("_pos"), F.col("d").alias("_d_before"))
        part = numbered.join(earlier, [*keys, "_pos"]).groupBy(*keys).agg(F.covar_samp("d", "_d_before").alias("_cov"))
        total = part if total is None else total.unionByName(part)
    return total.groupBy(*keys).agg(F.sum("_cov").alias("_gamma"))


def _dm_result(d: DataFrame, means: dict[str, Column], keys: Sequence[str], order: Sequence[str], h: int,
               alternative: str) -> DataFrame:
    group = list(keys) or ["_g"]
    d = d if keys else d.withColumn("_g", F.lit(0))
    agg = d.groupBy(*group).agg(F.count("d").alias("_n"), F.avg("d").alias("_mean"), F.var_samp("d").alias("_var"),
                                *[c.alias(n) for n, c in means.items()])
    if h > 1:
        agg = agg.join(_lagged_covariances(d, group, order, h), group, "left")
        variance = (F.col("_var") + F.lit(2.0) * F.coalesce("_gamma", F.lit(0.0))) / F.col("_n")
    else:
        variance = F.col("_var") / F.col("_n")
    stat = F.when((F.col("_n") >= 2) & (variance > 0), F.col("_mean") / F.sqrt(variance))
    p = F.lit(1.0) - normal_cdf(F.col("dm_statistic")) if alternative == "reference" else normal_cdf("dm_statistic")
    return agg.withColumn("dm_statistic", stat).withColumn("p_value", p).select(
        *keys, "dm_statistic", "p_value", *means)


def diebold_mariano(df: DataFrame, loss: str = "brier", h: int = 1, keys: Sequence[str] = (),
                    order: Sequence[str] = (), alternative: str = "model1_better", actual: str = "y_true",
                    first: str = "p1", second: str = "p2") -> DataFrame:
    """Equal predictive accuracy of two forecasts; a negative statistic means the first has the lower loss.

    ``alternative``: "model1_better" gives a small p-value when the first forecast is better, "reference" reports
    1 - cdf(statistic). ``order`` (unique) is needed for h > 1 only.
    """
    a = F.col(actual).cast("double")
    losses = df.select(*keys, *order, forecast_loss(a, F.col(first), loss).alias("e1"),
                       forecast_loss(a, F.col(second), loss).alias("e2"))
    d = losses.withColumn("d", F.col("e1") - F.col("e2"))
    out = _dm_result(d, {"mean_loss1": F.avg("e1"), "mean_loss2": F.avg("e2")}, keys, order, h, alternative)
    return out.withColumn("loss_used", F.lit(LOSS_NAMES[loss]))


def diebold_mariano_returns(df: DataFrame, h: int = 1, keys: Sequence[str] = (), order: Sequence[str] = ("date",),
                            first: str = "r1", second: str = "r2") -> DataFrame:
    """The same test on the difference of two daily returns paired by date: small p when the first earns more."""
    d = df.select(*keys, *order, F.col(first).alias("r1"), F.col(second).alias("r2")).withColumn(
        "d", F.col("r1") - F.col("r2"))
    root = math.sqrt(252)
    sharpe = [F.coalesce(div(F.avg(c), F.stddev_pop(c)) * root, F.lit(0.0)) for c in ("r1", "r2")]
    out = _dm_result(d, {"mean_return1": F.avg("r1"), "mean_return2": F.avg("r2"), "sharpe_diff": sharpe[0] - sharpe[1]},
                     keys, order, h, "reference")
    return out.withColumn("sharpe_diff", F.when(F.col("dm_statistic").isNotNull(), F.col("sharpe_diff")))


# bootstrap ------------------------------------------------------------------------------------------------------
def mean_statistic(w: Column, x: Column) -> Column:
    return div(F.sum(w * x), F.sum(w).cast("double"))


def sharpe_statistic(w: Column, x: Column, trading_days: int = 252) -> Column:
    n = F.sum(w).cast("double")
    mean = div(F.sum(w * x), n)
    std = F.sqrt(F.greatest(div(F.sum(w * x * x), n) - mean * mean, F.lit(0.0)))
    return F.coalesce(div(mean, std) * math.sqrt(trading_days), F.lit(0.0))


#: Replicates that one task draws at a time.
REPLICATE_BLOCK = 250


def _replicates(df: DataFrame, key: Sequence[str], value: str, n_bootstrap: int, seed: int) -> DataFrame:
    """Each row with its weight in every replicate. Resampling with replacement counts a row Poisson(1) times; the count
    comes from a hash of seed, replicate and row key, so no sample is stored and a retried task draws the same one. The
    exploded rows are folded into one partial sum per replicate before they leave the task. Replicates are dealt over the
    tasks in blocks, for a daily series comes in one partition."""
    blocks = -(-n_bootstrap // REPLICATE_BLOCK)
    dealt = df.select(*key, F.col(value).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    dealt = dealt.repartition(blocks, "_block")
    first = F.col("_block") * REPLICATE_BLOCK
    reps = F.explode(F.sequence(first, F.least(first + REPLICATE_BLOCK, F.lit(n_bootstrap)) - 1)).alias("rep")
    rows = dealt.select(*key, "_x", reps)
    return rows.withColumn("_w", poisson_one(hash_uniform(F.lit(seed), "rep", *key)))


def bootstrap_ci(df: DataFrame, value: str, key: Sequence[str], statistic: Callable[[Column, Column], Column] = mean_statistic,
                 n_bootstrap: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of a weighted statistic, with point estimate and standard error."""
    stats = (_replicates(df.where(F.col(value).isNotNull()), key, value, n_bootstrap, seed)
             .groupBy("rep").agg(statistic(F.col("_w"), F.col("_x")).alias("_s")))
    alpha = 1.0 - ci
    point = df.agg(statistic(F.lit(1), F.col(value)).alias("point_estimate"))
    spread = stats.agg(F.percentile("_s", alpha / 2).alias("ci_lower"), F.percentile("_s", 1 - alpha / 2).alias("ci_upper"),
                       F.stddev_pop("_s").alias("std_error"))
    # Two one-row tables.
    return point.withColumn("_one", F.lit(1)).join(spread.withColumn("_one", F.lit(1)), "_one").drop("_one")


def sharpe_bootstrap_ci(daily: DataFrame, value: str = "strategy_return", key: Sequence[str] = ("date",),
                        n_bootstrap: int = 10_000, ci: float = 0.95, trading_days: int = 252, seed: int = 42) -> DataFrame:
    return bootstrap_ci(daily, value, key, lambda w, x: sharpe_statistic(w, x, trading_days), n_bootstrap, ci, seed)


def bootstrap_ci_callable(daily: DataFrame, value: str, key: Sequence[str], statistic: Callable, n_bootstrap: int = 10_000,
                          ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of a user function ``array -> float``. Replicates are spread over tasks; one replicate holds one daily
    series, which the calendar bounds. Use ``bootstrap_ci`` for anything Columns can express."""
    import pandas as pd

    known = daily.where(F.col(value).isNotNull())
    drawn = _replicates(known, key, value, n_bootstrap, seed).where("_w > 0").select("rep", F.col("_x").cast("double").alias("_x"), F.col("_w").cast("int").alias("_w"))
    # the rows as they are give the point estimate, under a number that no replicate has
    drawn = drawn.unionByName(known.select(F.lit(-1).alias("rep"), F.col(value).cast("double").alias("_x"), F.lit(1).alias("_w")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = pdf["_x"].repeat(pdf["_w"]).to_numpy()
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "_s": [float(statistic(sample))]})

    stats = drawn.groupBy("rep").applyInPandas(one, "rep int, _s double")
    alpha, s = 1.0 - ci, F.when(F.col("rep") >= 0, F.col("_s"))
    return stats.agg(F.max(F.when(F.col("rep") < 0, F.col("_s"))).alias("point_estimate"), F.percentile(s, alpha / 2).alias("ci_lower"),
                     F.percentile(s, 1 - alpha / 2).alias("ci_upper"), F.stddev_pop(s).alias("std_error"))


# drift ----------------------------------------------------------------------------------------------------------
def long_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]))
    return df.select(pairs.alias("_p")).select("_p.feature", "_p.value").where(F.col("value").isNotNull())


def psi_table(reference: DataFrame, current: DataFrame, bins: int = 10, min_rows: int = 10) -> DataFrame:
    """Population stability per feature of two long (feature, value) tables: equal-width bins over the reference range,
    outer bins open. One job for all features; each side is folded to ``bins`` counts per feature."""
    edges = reference.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    edges = edges.select("feature", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                         F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")).alias("_span"))
    both = reference.withColumn("_cur", F.lit(0)).unionByName(current.withColumn("_cur", F.lit(1)))
    # One row of two numbers per feature column: bounded by the width of the table.
    placed = both.join(F.broadcast(edges), "feature")
    slot = F.floor((F.col("value") - F.col("_lo")) / (F.col("_span") / bins))
    placed = placed.withColumn("bin", F.least(F.greatest(slot, F.lit(0)), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy("feature", "bin").agg(
        F.count(F.when(F.col("_cur") == 0, 1)).alias("_r"), F.count(F.when(F.col("_cur") == 1, 1)).alias("_c"))
    return _shares(counts, min_rows)


def _shares(counts: DataFrame, min_rows: int) -> DataFrame:
    """(feature, psi) of (feature, bin, _r, _c), the rows of a bin on both sides."""
    # At most ``bins`` rows per feature from here on. A bin empty on both sides adds (eps - eps) * ln(1) = 0: no row needed.
    whole = Window.partitionBy("feature")
    shares = counts.select("feature", "_r", "_c", F.sum("_r").over(whole).alias("_nr"), F.sum("_c").over(whole).alias("_nc"))
    shares = shares.where((F.col("_nr") >= min_rows) & (F.col("_nc") >= min_rows))
    r = F.col("_r") / F.col("_nr") + F.lit(1e-6)
    c = F.col("_c") / F.col("_nc") + F.lit(1e-6)
    return shares.groupBy("feature").agg(F.sum((c - r) * F.ln(c / r)).alias("psi"))


def population_stability_index(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    return psi_table(long_features(reference, [value]), long_features(current, [value]), bins, 1).select("psi")


def _known(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's values, 0 where there is none, and where there are some."""
    c = batch.column(column)
    return pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)


def feature_psi(train: DataFrame, test: DataFrame, names: Sequence[str], threshold: float = 0.25, bins: int = 10, min_rows: int = 10
                ) -> DataFrame:
    """``psi_table`` of the columns of wide tables: rows are not multiplied by the features, tasks hand on ``bins`` counts for each. ``train`` is read twice."""
    wide = lambda df: df.select(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(len(names), np.inf), np.full(len(names), -np.inf)
        seen = np.zeros(len(names), bool)
        for batch in batches:
            for i in range(len(names)):
                v, known = _known(batch, f"x{i}")
                v = v[known & ~np.isnan(v)]
                if len(v):
                    seen[i], lo[i], hi[i] = True, min(lo[i], v.min()), max(hi[i], v.max())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(lo[at]), pa.array(hi[at])], names=["place", "lo", "hi"])

    spans = {}
    for r in wide(train).mapInArrow(ends, "place int, lo double, hi double").groupBy("place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # a row for each feature
        spans[r["place"]] = (r["lo"] - 0.5, 1.0 / bins) if r["lo"] == r["hi"] else (r["lo"], (r["hi"] - r["lo"]) / bins)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(names), 2, bins), np.int64)
        for batch in batches:
            now = batch.column("now").to_numpy(zero_copy_only=False)
            for i, (lo, width) in spans.items():
                v, known = _known(batch, f"x{i}")
                known &= ~np.isnan(v)
                with np.errstate(all="ignore"):
                    slot = np.clip(np.nan_to_num(np.floor((v[known] - lo) / width)), 0, bins - 1).astype(np.int64)
                n[i] += np.bincount(now[known] * bins + slot, minlength=2 * bins).reshape(2, bins)
        place, bin_ = (x.ravel() for x in np.indices((len(names), bins)))
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(bin_, pa.int32()), pa.array(n[:, 0].ravel()), pa.array(n[:, 1].ravel())], names=["place", "bin", "_r", "_c"])

    both = wide(train).withColumn("now", F.lit(0)).unionByName(wide(test).withColumn("now", F.lit(1)))
    counts = both.mapInArrow(counted, "place int, bin int, _r long, _c long").groupBy("place", "bin").agg(F.sum("_r").alias("_r"), F.sum("_c").alias("_c"))
    named = counts.where("_r + _c > 0").select(F.array(*[F.lit(n) for n in names])[F.col("place")].alias("feature"), "bin", "_r", "_c")
    return _shares(named, min_rows).withColumn("drifted", F.col("psi") >= threshold).orderBy(F.col("psi").desc(), "feature")


def ks_two_sample(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Largest distance of two empirical distributions, with the asymptotic p-value."""
    tagged = left.select(F.col(value).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        right.select(F.col(value).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where(F.col("x").isNotNull())
    points = tagged.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    scanned = sorted_scan(points, [], ["x"], {"ca": "a", "cb": "b"}, totals=True)
    gap = F.abs(F.col("ca") / F.col("ca_total") - F.col("cb") / F.col("cb_total"))
    stat = scanned.agg(F.max(gap).alias("ks_statistic"), F.max("ca_total").alias("_m"), F.max("cb_total").alias("_n"))
    scale = F.sqrt(F.col("_m") * F.col("_n").cast("double") / (F.col("_m") + F.col("_n")))
    lam = scale * F.col("ks_statistic")
    # Kolmogorov series; its terms fall off as exp(-2 k^2 lam^2).
    terms = F.lit(0.0)
    for k in range(1, 101):
        terms = terms + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    p = F.when(lam < 0.05, F.lit(1.0)).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))
    return stat.select("ks_statistic", p.alias("p_value"))


# leakage --------------------------------------------------------------------------------------------------------
def leakage_check(matrix: DataFrame, names: Sequence[str], target: str = "fwd_return", limit: float = 0.5,
                  min_pairs: int = 50) -> DataFrame:
    """Features whose correlation with the target is suspicious. All features in one scan: a task hands on the moments of each feature's pairs, which are
    taken about their means and put together by feature, a row for each task."""
    kinds = "place int, n long, x double, y double, xx double, yy double, xy double"

    def joined(a: tuple, b: tuple) -> tuple:
        """Moments of both (number, means, sums of squares and products about the means)."""
        n = a[0] + b[0]
        dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
        return n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            y, told = _known(batch, "y")
            for i in range(len(names)):
                x, known = _known(batch, f"x{i}")
                both = known & told
                if both.any():
                    a, b = x[both], y[both]
                    u, v = a - a[0], b - b[0]  # a constant column has no deviation
                    mu, mv = u.mean(), v.mean()
                    u, v = u - mu, v - mv
                    part = (len(a), float(a[0] + mu), float(b[0] + mv), float(u @ u), float(v @ v), float(u @ v))
                    held[i] = joined(held[i], part) if i in held else part
        yield pa.RecordBatch.from_pylist([dict(zip(("place", "n", "x", "y", "xx", "yy", "xy"), (i, *m), strict=True)) for i, m in held.items()], schema=pa.schema(
            [("place", pa.int32()), ("n", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "xx", "yy", "xy"))]))

    def whole(table: pa.Table) -> pa.Table:
        rows = sorted(tuple(r.values()) for r in table.to_pylist())
        found = functools.reduce(joined, [r[1:] for r in rows])
        return pa.table([pa.array([v], t) for v, t in zip((rows[0][0], *found), table.schema.types, strict=True)], names=table.column_names)

    told = matrix.select(F.col(target).cast("double").alias("y"), *[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)]).mapInArrow(moments, kinds)
    every = matrix.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, feature string")
    found = every.join(told.groupBy("place").applyInArrow(whole, kinds), "place", "left").orderBy("place")
    less = F.col("n") - 1
    corr = F.when(F.col("n") > 1, div(F.col("xy") / less, F.sqrt(F.col("xx") / less) * F.sqrt(F.col("yy") / less)))
    rows = found.select("feature", F.coalesce("n", F.lit(0)).cast("long").alias("n_pairs"), corr.alias("corr"))
    return rows.withColumn("suspicious", (F.col("n_pairs") >= min_pairs) & F.coalesce(F.abs("corr") > limit, F.lit(False)))


# reports --------------------------------------------------------------------------------------------------------
def significance_table(dm: dict[str, DataFrame], bootstraps: dict[str, DataFrame]) -> DataFrame:
    """One row per test. DM is significant below p .05, a bootstrap when its lower bound is positive."""
    null = F.lit(None).cast("double")
    rows = [d.select(F.lit(f"DM: {n}").alias("test"), F.col("dm_statistic").alias("statistic"), "p_value",
                     null.alias("ci_lower"), null.alias("ci_upper"),
                     F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant")) for n, d in dm.items()]
    rows += [b.select(F.lit(f"Bootstrap 95% CI: {n}").alias("test"), F.col("point_estimate").alias("statistic"),
                      null.alias("p_value"), "ci_lower", "ci_upper",
                      F.coalesce(F.col("ci_lower") > 0, F.lit(False)).alias("significant")) for n, b in bootstraps.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
