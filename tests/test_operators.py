"""Operators against brute force and pandas, leakage invariants, and hand-made rule cases."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.config import FoldSettings, RegimeSettings
from tickerloom.functions.scan import exact_quantiles, most_frequent, ranges_of, sorted_scan
from tickerloom.functions.series import Rolled, Series, apply_stages, expanding_pct_rank, sum_chain, with_ewm, with_rolled
from tickerloom.operators import alignment, cleaning, features, folds, metrics, models, portfolio, quality, regime, tabular
from tickerloom.sources import tables

K = Series()


@pytest.fixture(scope="module")
def pandas_bars():
    rng = np.random.default_rng(7)
    frames = []
    for t in ("AAA", "BBB", "CCC"):
        close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, 300)))
        frames.append(pd.DataFrame({
            "date": [date(2020, 1, 1) + timedelta(days=i) for i in range(300)], "ticker": t, "open": close * 0.99,
            "high": close * 1.02, "low": close * 0.97, "close": close, "volume": rng.integers(1000, 5000, 300).astype(float)}))
    return pd.concat(frames)


@pytest.fixture(scope="module")
def panel(spark, pandas_bars):
    return cleaning.process_bars(spark.createDataFrame(pandas_bars)).persist()


def _sorted(df, column):
    return df.toPandas().sort_values(["ticker", "date"])[column].to_numpy(dtype=float)


def test_sorted_scan_with_one_dominant_key(spark):
    rows = [("hot", i * 7919 % 5000, i % 5) for i in range(5000)] + [("cold", i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, v int, w int")
    got = sorted_scan(df, ["k"], ["v"], {"run": "w", "n": F.lit(1)}, totals=True).toPandas()
    want = pd.DataFrame(rows, columns=["k", "v", "w"]).sort_values(["k", "v"])
    want["run"] = want.groupby("k")["w"].cumsum()
    both = got.merge(want, on=["k", "v"], suffixes=("", "_want"))
    assert len(both) == len(rows) and (both["run"] == both["run_want"]).all()
    assert set(got[got.k == "hot"].run_total) == {want[want.k == "hot"].w.sum()}


def test_sorted_scan_keeps_null_keys_and_balances(spark):
    df = spark.range(1_000_000).select(F.when(F.col("id") % 10 > 0, F.lit("hot")).alias("k"), F.xxhash64("id").alias("v"))
    got = sorted_scan(df, ["k"], ["v"], {"n": F.lit(1)}, totals=True).groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.max("n_total").alias("t")).collect()
    assert {x.k: (x.c, x.m, x.t) for x in got} == {None: (100_000,) * 3, "hot": (900_000,) * 3}
    sizes = [x["count"] for x in ranges_of(df, ["k"], ["v"]).groupBy("_range").count().collect()]
    assert max(sizes) <= 50_000


def test_null_groups_in_users_of_the_scan(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, (F.col("id") % 3).cast("string")).alias("c"))
    split = tabular.stratified_split(df, "id", "c")
    assert split.count() == 1000 and split.where("c IS NULL AND is_train").count() > 0
    scores = spark.range(200).select(F.when(F.col("id") % 2 > 0, "a").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y_true"),
                                     (F.col("id") % 2).cast("int").alias("y_pred"), (F.col("id") / 200).alias("y_proba"))
    rows = metrics.classification_metrics(scores, ["g"]).collect()
    assert sorted(str(x.g) for x in rows) == ["None", "a"] and all(x.auc_roc is not None for x in rows)


def test_exact_quantiles_and_mode(spark):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 300, 4001)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    row = exact_quantiles(df, ["k"], "v", {"median": 0.5, "q9": 0.9}).first()
    assert row["median"] == np.median(values) and abs(row["q9"] - np.quantile(values, 0.9)) < 1e-9
    assert most_frequent(df, ["k"], "v").first()["mode"] == pd.Series(values).mode().iloc[0]


def test_ewm_and_sums_match_pandas(spark, panel, pandas_bars):
    got = with_ewm(panel, "close", [9, 200])
    by = pandas_bars.groupby("ticker")["close"]
    for span in (9, 200):
        want = by.transform(lambda s: s.ewm(span=span, adjust=False).mean()).to_numpy()
        assert np.allclose(_sorted(got, f"ema_{span}"), want, rtol=1e-12)
    chain = sum_chain(K, "volume", 37)
    want = pandas_bars.groupby("ticker")["volume"].transform(lambda s: s.rolling(37).sum()).to_numpy()
    assert np.allclose(_sorted(apply_stages(panel, chain.stages), chain.output), want, equal_nan=True)


def test_expanding_rank_matches_pandas(spark, panel, pandas_bars):
    rounded = panel.withColumn("c", F.round("close", 0))
    want = pandas_bars.assign(c=pandas_bars.close.round(0)).groupby("ticker")["c"].transform(lambda s: s.expanding(60).rank(pct=True))
    assert np.allclose(_sorted(expanding_pct_rank(rounded, "c", "r", 60, K), "r"), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("make", [features.rsi, features.macd, features.atr, features.ema, features.adx, features.obv_z])
def test_lagged_feature_is_shifted_feature(panel, make):
    name = next(iter(make().outputs))
    now = features.build(panel, [make()], lag=0).toPandas().sort_values(["ticker", "date"])
    before = _sorted(features.build(panel, [make()], lag=1), name)
    assert np.allclose(now.groupby("ticker")[name].shift(1).to_numpy(dtype=float), before, equal_nan=True)
    assert not np.allclose(now[name].to_numpy(dtype=float), before, equal_nan=True)


def test_features_do_not_see_the_future(panel):
    cut = date(2020, 8, 1)
    names = ["rsi_14", "macd_signal", "ema_200", "adx_14", "obv_z", "dist_52w_high", "zscore_60"]
    whole = features.technical_features(panel).where(F.col("date") < cut).select("ticker", "date", *names).toPandas()
    part = features.technical_features(panel.where(F.col("date") < cut)).select("ticker", "date", *names).toPandas()
    key = ["ticker", "date"]
    a, b = (x.sort_values(key)[names].to_numpy(dtype=float) for x in (whole, part))
    assert np.allclose(a, b, equal_nan=True)


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(3)
    drift = np.repeat([0.004, -0.006, 0.0], 200)
    close = 1000 * np.exp(np.cumsum(rng.normal(drift, 0.008)))
    rows = pd.DataFrame({"date": [date(2018, 1, 1) + timedelta(days=i) for i in range(600)], "close": close})
    for c in ("open", "high", "low"):
        rows[c] = rows.close
    rows["volume"] = 1.0
    return cleaning.process_index(spark.createDataFrame(rows)).persist()


REGIME = RegimeSettings(em_iterations=4, changepoint_penalty=0.001)


@pytest.mark.parametrize("make", [regime.mixture_state, regime.changepoints, regime.rule_regime])
def test_regimes_do_not_see_the_future(index, make):
    cut = date(2018, 1, 1) + timedelta(days=500)
    a = make(index, REGIME).where(F.col("date") < cut).toPandas().sort_values("date")
    b = make(index.where(F.col("date") < cut), REGIME).toPandas().sort_values("date")
    for c in {"state", "cp_flag", "days_since_cp", "rule_regime"} & set(a.columns):
        assert (a[c].to_numpy() == b[c].to_numpy()).all()


def test_detected_regimes_are_complete(index):
    out = regime.detect_regime(index, REGIME).toPandas()
    assert len(out) == 600 and set(out.regime) <= {0, 1, 2}
    assert out.cp_flag.fillna(0).sum() >= 1


def test_folds_clip_month_ends():
    found = folds.generate_folds(date(2015, 1, 31), date(2021, 12, 31), FoldSettings(1, 1, 1))
    assert found[0].train_end == date(2015, 2, 28) and found[1].train_end == date(2015, 3, 28)
    assert found[-1].test_end <= date(2021, 12, 31)


def test_membership_by_walking_back(spark):
    changes = spark.createDataFrame([("A", date(2020, 6, 1), "added"), ("B", date(2020, 6, 1), "removed"),
                                     ("B", date(2019, 1, 1), "added")], "ticker string, date date, action string")
    current = spark.createDataFrame([("A",), ("C",)], "ticker string")
    spans = alignment.membership_spans(changes, current)
    on = lambda d: sorted(r["ticker"] for r in alignment.members_on(spans, d).collect())
    assert on("2018-01-01") == ["C"] and on("2019-06-01") == ["B", "C"] and on("2021-01-01") == ["A", "C"]


def test_portfolio_by_hand(spark):
    d = [date(2020, 1, i) for i in (1, 2, 3)]
    scores = spark.createDataFrame([(x, t, p) for x in d for t, p in (("A", 0.1), ("B", 0.9))], "date date, ticker string, y_proba double")
    prices = spark.createDataFrame([(d[0], "A", 100.0), (d[1], "A", 110.0), (d[2], "A", 99.0), (d[0], "B", 10.0), (d[1], "B", 10.0)],
                                   "date date, ticker string, close double")
    out = {r["date"]: r for r in portfolio.simulate_portfolio(scores, prices).collect()}
    cost = 2 / 3 * 0.0025 * 2
    assert abs(out[d[1]]["strategy_return"] - (0.1 - cost)) < 1e-12 and abs(out[d[1]]["benchmark_return"] - 0.05) < 1e-12
    assert abs(out[d[2]]["benchmark_return"] + 0.05) < 1e-12 and out[d[2]]["n_positions"] == 1


def test_auc_of_separable_and_single_class(spark):
    rows = [("x", int(i > 50), i / 100, int(i > 50)) for i in range(100)] + [("y", 1, 0.5, 1)]
    out = {r["g"]: r for r in metrics.classification_metrics(
        spark.createDataFrame(rows, "g string, y_true int, y_proba double, y_pred int"), ["g"]).collect()}
    assert out["x"]["auc_roc"] == 1.0 and out["y"]["auc_roc"] is None and out["x"]["f1_score"] == 1.0


CASES = [("precision", 0.61, {"fabrication_check", "roundness_check"}), ("auc_roc", 1.5, {"range_check", "roundness_check"}),
         ("sharpe", float("nan"), {"nan_inf_check"}), ("recall", None, {"null_check"}), ("accuracy", 0.7312345, set()),
         ("p_value", 0.03, set()), ("max_drawdown", 0.0, set()), ("f1_score", float("inf"), {"nan_inf_check"})]


@pytest.mark.parametrize("name,value,want", CASES)
def test_integrity_rules(spark, name, value, want):
    rows = spark.createDataFrame([("c", name, value)], "context string, name string, value double")
    assert {r["check"] for r in quality.metrics_integrity(rows).collect()} == want


def test_lint_rules(spark):
    lines = ["if prec == 0: prec = 0.61", "recall = compute()", "# realistic demo numbers", "# DEPRECATED demo", "sharpe: 1.42"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    assert sorted(r["line_no"] for r in quality.lint_hardcoded_metrics(df).collect()) == [0, 2, 4]


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="high"):
        tables.standardise_columns(spark.createDataFrame([(1, 2.0)], "time int, open double"))


def test_file_registry_and_listing(spark, tmp_path):
    for n, text in (("a.csv", "x"), ("b.csv", "x"), ("c.TXT", "y"), ("d.bin", "z")):
        (tmp_path / n).write_text(text)
    status = {r["path"][-5:]: r["status"] for r in tables.register_files(spark, str(tmp_path)).collect()}
    assert status["a.csv"] == "created" and status["b.csv"] == "deduplicated" and status["c.TXT"] == "created"
    assert {r["name"] for r in tables.list_artifacts(spark, str(tmp_path)).collect()} == {"a.csv", "b.csv", "c.TXT"}


def test_models_learn_a_separable_label(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 0)) for a, b in x], "a double, b double, label int")
    rows = models.assemble(df, ["a", "b"])
    scored = models.score(models.booster(models.small_settings(5, 3)).fit(rows), rows)
    out = scored.select(F.col("label").alias("y_true"), "y_proba", models.predict_binary("y_proba").alias("y_pred"))
    row = metrics.classification_metrics(out).first()
    assert row["auc_roc"] > 0.9 and scored.where("y_proba < 0 OR y_proba > 1").count() == 0


def test_split_shares(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(1000)], "id int, c string")
    out = tabular.stratified_split(df, "id", "c").groupBy("c").agg(F.sum(F.col("is_train").cast("int")).alias("n")).collect()
    assert {r["c"]: r["n"] for r in out} == {"big": 720, "small": 80}


def test_rolled_deviations_and_correlations_by_brute_force(spark):
    """Missing values, constant windows, a level far from zero, short series, a null key; no frame is summed anew for each row."""
    r = np.random.default_rng(2)
    df = pd.DataFrame({"k": ["a"] * 80 + ["b"] * 3 + [None] * 30, "t": r.permutation(113), "x": np.round(r.normal(size=113), 2) + 1e9, "y": r.normal(size=113)})
    df.loc[20:40, "x"], df.loc[r.random(113) < 0.1, "y"] = 1e9 + 0.1, None
    rows = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False)], "k string, t int, x double, y double")
    found = with_rolled(rows, {"sd": Rolled("y", 10, 4), "flat": Rolled("x", 5), "corr": Rolled("x", 10, 4, "y")}, Series(("k",), ("t",))).toPandas()
    same = lambda v, want: (pd.isna(v) and want is None) or v == pytest.approx(want, rel=1e-6, abs=1e-9)
    for k in ("a", "b", None):
        mine = found[found.k.isna() if k is None else found.k == k].sort_values("t").reset_index(drop=True)
        for i, row in mine.iterrows():
            ten, five = mine.iloc[max(0, i - 9):i + 1], mine.iloc[max(0, i - 4):i + 1]
            pairs = ten.dropna(subset=["y"])
            level = pairs.x - 1e9
            assert same(row.sd, pairs.y.std() if len(pairs) >= 4 else None)
            assert same(row.flat, (five.x - 1e9).std() if len(five) == 5 else None) and (len(five) < 5 or five.x.nunique() > 1 or row.flat == 0.0)
            assert same(row["corr"], level.corr(pairs.y) if len(pairs) >= 4 and level.nunique() > 1 else None)
    panel = spark.createDataFrame([("a", 1, 0.1, 0.2)], "ticker string, date int, returns double, index_returns double")
    plan = features.build(panel, [features.index_correlation()])._jdf.queryExecution().optimizedPlan().toString()
    assert "covar_samp" not in plan and "-59" not in plan


def test_a_cache_reads_rows_that_are_there_once(spark, folder, monkeypatch):
    """The cache query marks its rows twice and builds from them; the bars are made once."""
    from tickerloom.catalog import panel_queries

    plans, marked = [], tables.table_fingerprint
    monkeypatch.setattr(tables, "table_fingerprint", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or marked(df))
    assert panel_queries._cache(spark, folder).count() > 1000
    assert len(plans) == 2 and not any("Aggregate" in p for p in plans)
    assert marked(spark.range(0)).first().content_hash is None


def test_index_correlation_makes_its_bars_once(spark, folder):
    from tickerloom.catalog.all import QUERIES

    found = QUERIES["fe24_index_correlation"].build(spark, folder)
    assert "min_by" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 1000
