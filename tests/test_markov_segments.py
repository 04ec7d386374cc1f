from dataclasses import replace
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.config import RegimeSettings
from tickerloom.operators import cleaning, regime
from tickerloom.operators import markov as mk
from tickerloom.operators import segmentation as sg

SETTINGS = RegimeSettings(em_iterations=15, changepoint_penalty=0.001)
CHAIN = mk.Chain((0.6, 0.4), ((0.9, 0.1), (0.3, 0.7)), ((0.5, 1.0), (-0.5, 1.5)), ((1.0, 0.1, 0.4), (1.5, -0.2, 0.6)))


@pytest.fixture(scope="module")
def index(spark):
    r = np.random.default_rng(5)
    n = 420
    steps = np.where(np.arange(n) // 70 % 2, -0.006, 0.006) + r.normal(0, 0.01, n)
    rows = pd.DataFrame({"series_id": "A", "date": [date(2018, 1, 1) + timedelta(days=i) for i in range(n)], "close": 100 * np.exp(np.cumsum(steps))})
    rows = pd.concat([rows, rows.assign(series_id="B", close=100 * np.exp(np.cumsum(-steps)))])
    for c in ("open", "high", "low"):
        rows[c] = rows.close
    rows["volume"] = 1.0
    return cleaning.process_index(spark.createDataFrame(rows)).cache()


def slow_posteriors(x, y, c):
    """Row by row, without blocks."""
    b = np.exp(mk.emissions(x, y, c))
    a, n = np.array(c.moves), len(x)
    forward, backward = np.zeros(b.shape), np.ones(b.shape)
    likelihood = 0.0
    for t in range(n):
        v = np.array(c.start) * b[0] if t == 0 else forward[t - 1] @ a * b[t]
        forward[t], likelihood = v / v.sum(), likelihood + np.log(v.sum())
    for t in reversed(range(n - 1)):
        v = a @ (b[t + 1] * backward[t + 1])
        backward[t] = v / v.sum()
    both = forward * backward
    return forward, both / both.sum(axis=1, keepdims=True), likelihood


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 500])
def test_blocks_equal_one_row_after_the_other(n):
    r = np.random.default_rng(n)
    x, y = r.normal(size=n), r.normal(1, 0.5, size=n)
    filtered, smoothed, likelihood = slow_posteriors(x, y, CHAIN)
    steps, _ = mk.step_matrices(mk.emissions(x, y, CHAIN), CHAIN, True)
    assert np.allclose(mk.passes(steps, np.ones(2), np.ones(2), width=8)[0], filtered)
    shares, moves, found = mk.expectation(x, y, CHAIN)
    assert np.allclose(shares, smoothed) and found == pytest.approx(likelihood) and moves.sum() == pytest.approx(n - 1)


@pytest.mark.parametrize("size", [7, 100, 4096])
def test_a_chain_is_spread_over_tasks(spark, size):
    r = np.random.default_rng(8)
    rows = [(s, i, float(r.normal()), float(r.normal(1, 0.5)), "z") for s, n in (("a", 230), ("b", 1), (None, 15)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, _pos int, x double, y double, _at string").drop("_at").repartition(4)
    out = mk.posteriors(df.where("series_id is not null"), CHAIN, ["series_id"], size=size).toPandas()
    assert len(out) == 231
    for s, own in out.groupby("series_id"):
        own = own.sort_values("_pos")
        filtered, smoothed, _ = slow_posteriors(own.x.to_numpy(), own.y.to_numpy(), CHAIN)
        assert np.allclose(np.stack(own.filtered), filtered) and np.allclose(np.stack(own.smoothed), smoothed)
    assert mk.posteriors(df.limit(0), CHAIN, ["series_id"]).count() == 0


def test_likelihood_never_falls_and_states_are_found():
    r = np.random.default_rng(2)
    state = np.arange(900) // 60 % 2
    x, y = r.normal(np.where(state, -1.0, 1.0), 1.0), r.normal(np.where(state, 2.0, 1.0), 0.3)
    chain, past = mk.fitted(x, y, 2, 100, 1e-6)
    assert len(past) > 3 and all(b >= a - 1e-7 for a, b in zip(past, past[1:]))
    assert chain.means[0][0] > 0.8 and chain.means[1][0] < -0.8 and min(chain.moves[0][0], chain.moves[1][1]) > 0.9
    filtered, _, _ = slow_posteriors(x, y, chain)
    assert (filtered.argmax(axis=1) == state).mean() > 0.97


@pytest.mark.parametrize("make", [mk.markov_state, sg.optimal_changepoints])
def test_nothing_later_moves_a_row(index, make):
    cut = date(2018, 1, 1) + timedelta(days=350)
    a = make(index, SETTINGS).where(F.col("date") < cut).toPandas().sort_values(["series_id", "date"])
    b = make(index.where(F.col("date") < cut), SETTINGS).toPandas().sort_values(["series_id", "date"])
    assert len(a) == len(b) > 100
    for c in a.columns:
        assert (a[c].to_numpy() == b[c].to_numpy()).all()


def cost_of(values, breaks, penalty):
    ends = [0, *breaks, len(values)]
    return sum(((values[a:b] - values[a:b].mean()) ** 2).sum() for a, b in zip(ends, ends[1:])) + penalty * len(breaks)


@pytest.mark.parametrize("size,penalty", [(1, 0.5), (2, 0.3), (3, 1.0), (4, 0.05)])
def test_optimum_equals_brute_force(size, penalty):
    r = np.random.default_rng(size)
    for _ in range(12):
        values = np.repeat(r.normal(size=4), 3)[:r.integers(size, 12)]
        values = values + r.normal(0, 0.3, len(values))
        cost, last = sg.optimal_prefixes(values, size, penalty)
        for t in range(size, len(values) + 1):
            options = [c for m in range(t) for c in combinations(range(1, t), m) if all(b - a >= size for a, b in zip((0, *c), (*c, t)))]
            best = min(cost_of(values[:t], list(c), penalty) for c in options)
            assert cost[t] == pytest.approx(best) and cost_of(values[:t], sg.breaks_of(last, t), penalty) == pytest.approx(best)


def test_pruning_changes_nothing_and_greedy_is_never_better(spark, index):
    found = {(r["series_id"], r["block_start"]): r for r in sg.optimal_fits(index, SETTINGS).collect()}
    returns = {s: g.sort_values("date").returns.dropna().to_numpy() for s, g in index.toPandas().groupby("series_id")}
    assert any(r["breaks"] for r in found.values())
    for (s, t), row in found.items():
        v = returns[s][:t]
        assert row["cost"] == pytest.approx(cost_of(v, row["breaks"], SETTINGS.changepoint_penalty))
        plain, _ = sg.optimal_prefixes(v, SETTINGS.changepoint_min_size, SETTINGS.changepoint_penalty)
        greedy, todo = [], [(0, t)]
        while todo:
            a, b = todo.pop()
            cuts = [(cost_of(v[a:b], [c - a], 0) - cost_of(v[a:b], [], 0), c) for c in range(a + 20, b - 19)]
            if cuts and -min(cuts)[0] > SETTINGS.changepoint_penalty:
                greedy.append(min(cuts)[1])
                todo += [(a, greedy[-1]), (greedy[-1], b)]
        assert row["cost"] == pytest.approx(plain[t]) and row["cost"] <= cost_of(v, sorted(greedy), SETTINGS.changepoint_penalty) + 1e-12
    flags = sg.optimal_changepoints(index, SETTINGS).toPandas()
    assert len(flags) == sum(map(len, returns.values())) and flags.cp_flag.sum() >= 1
    short = replace(SETTINGS, min_train_rows=10_000)
    assert sg.optimal_changepoints(index, short).where("cp_flag = 1").count() == 0 and regime.changepoints(index, short).count() == len(flags)
