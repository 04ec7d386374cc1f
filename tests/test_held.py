"""Features computed from whole columns of a series."""

import random
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest

from tickerloom.functions.series import (
    Held, Rolled, Series, apply_stages, ewm_chain, extreme_chain, merge_stages, part_sum_chain, sum_chain, with_rolled)
from tickerloom.operators import cleaning, features

K = Series(("k",), ("t",))


@pytest.fixture(scope="module")
def data():
    """Series of 1, 2, 30 and 300 rows, one with missing values."""
    r = random.Random(4)
    return {k: [None if k == "gaps" and r.random() < 0.1 else round(100 * (1 + r.gauss(0, 0.02)), 3) for _ in range(n)] for k, n in (("one", 1), ("two", 2), ("gaps", 300), ("short", 30))}


def test_blocks_of_held_rows_are_those_of_the_chains(spark, data):
    """The same additions in the same order: equal to the last digit, missing in the same rows."""
    df = spark.createDataFrame([(k, t, v) for k, vs in data.items() for t, v in enumerate(vs)], "k string, t int, x double")
    chains = {"sum": sum_chain(K, "x", 60), "part": part_sum_chain(K, "y", 10, lead=1), "top": extreme_chain(K, "max", "x", 252, 60), "low": extreme_chain(K, "min", "x", 14),
              "fast": ewm_chain(K, "e12", "x", 12), "slow": ewm_chain(K, "e200", "x", 200)}
    staged = apply_stages(df, merge_stages([{"y": df["x"] * 1.0}], *[c.stages for c in chains.values()]))
    rolled = with_rolled(staged.select("k", "t", "x", *[staged[c.output].alias(n) for n, c in chains.items()]), {"sd": Rolled("x", 20), "some": Rolled("x", 60, 20)}, K).toPandas()
    for k, vs in data.items():
        want = rolled[rolled.k == k].sort_values("t")
        r = Held(pa.table({"x": pa.array(vs, pa.float64())}))
        found = {"sum": r.sum("x", None, 60), "part": r.sum("x", None, 10, 0.0), "top": r.extreme("max", "x", 252, 60), "low": r.extreme("min", "x", 14), "fast": r.ewm("x", None, 12),
                 "slow": r.ewm("x", None, 200), "sd": r.std("x", 20), "some": r.std("x", 60, 20)}
        for name, values in found.items():
            assert np.array_equal(values, want[name].to_numpy(dtype=float), equal_nan=True), (k, name)
    assert np.isnan(Held(pa.table({"x": pa.array([None, None], pa.float64())})).ewm("x", None, 9)).all()


def test_a_matrix_is_made_in_one_pass_of_each_series(spark, data):
    """Rows of forty features go through no window; a missing value takes the last known one, null tickers are a series."""
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(300)]
    rows = [(d, None if k == "gaps" else k, v, v * 1.01, v * 0.99, v, 5.0 + i % 7) for k, vs in data.items() for i, (d, v) in enumerate(zip(days, [v or 100.0 for v in vs]))]
    bars = cleaning.derive_bar_columns(spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double"))
    matrix = features.build_feature_matrix(bars, keep_tail=True)
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") <= 2 and plan.count("FlatMapGroupsInArrow") == 1
    kept = matrix.toPandas()
    assert kept.ticker.isna().all() and 200 < len(kept) < 300
    plain = features.build(bars, features.technical_sets(), lag=1).toPandas().sort_values("date")
    plain = plain[plain.ticker.isna()].set_index("date")
    filled = features.build(bars, features.technical_sets(), lag=1, fill=True).toPandas().sort_values("date")
    filled = filled[filled.ticker.isna()].set_index("date")
    assert np.allclose(plain.obv_z.ffill().to_numpy(), filled.obv_z.to_numpy(), equal_nan=True) and np.allclose(plain.ret_lag_5.to_numpy(), plain.returns.shift(5).to_numpy(), equal_nan=True)
