import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickerloom.config import FoldSettings, ModelSettings, RegimeSettings, Settings, StatisticSettings
from tickerloom.plans.study import run_study
from tickerloom.sources import tables


def test_a_users_csv_becomes_a_study(spark, tmp_path):
    """Column names of an upload, no index of its own: every table is written, every row of a test period is scored by every model."""
    r = np.random.default_rng(1)
    days = pd.bdate_range("2018-01-01", periods=900)
    rows = pd.concat([pd.DataFrame({"Date": days, "Symbol": t, "Close": 50 * np.exp(np.cumsum(r.normal(0, 0.02, len(days))))}) for t in ("AA", "BB", "CC")])
    for c in ("Open", "High", "Low"):
        rows[c] = rows.Close * {"Open": 1.0, "High": 1.01, "Low": 0.99}[c]
    rows["Volume"] = r.integers(1_000, 9_000, len(rows))
    rows.to_csv(tmp_path / "bars.csv", index=False)
    bars = tables.standardise_columns(tables.scan_csv(spark, str(tmp_path / "bars.csv"))).withColumn("date", F.to_date("date")).withColumn("volume", F.col("volume").cast("double"))
    settings = Settings(folds=FoldSettings(initial_train_months=6, test_months=3, step_months=3), model=ModelSettings(max_rounds=6, fine_tune_rounds=2, patience=3, l1=0.0, l2=1.0),
                        statistics=StatisticSettings(n_bootstrap=50), regime=RegimeSettings(em_iterations=5, changepoint_penalty=0.003))
    found = run_study(bars, None, str(tmp_path / "work"), settings)
    per_model = {x["model"]: x["n"] for x in found.predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(per_model) == {"base", "transfer", "ensemble", "static", "second", "random", "hold"} and len(set(per_model.values())) == 1 and min(per_model.values()) > 20
    assert found.predictions.where("y_proba < 0 OR y_proba > 1 OR y_proba IS NULL").count() == 0 and found.daily.count() > 5
    assert set(found.tables) == {"model_comparison", "model_table", "regime_performance", "portfolio_metrics", "significance", "integrity"}
    assert all(list((tmp_path / "work" / "tables" / n).glob("*.csv")) for n in found.tables)
