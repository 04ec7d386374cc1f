"""Hidden Markov states of index series: chains cut into blocks whose step matrices multiply to one small matrix each."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.config import RegimeSettings
from tickerloom.functions.series import Series
from tickerloom.operators.cleaning import INDICES
from tickerloom.operators.regime import MIN_VARIANCE, MIN_WEIGHT, mixture_observations, refit_blocks
from tickerloom.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan, executors need no copy of the package


@dataclass(frozen=True)
class Chain:
    """Start and transition probabilities, and each state's mean and covariance (xx, xy, yy) of two observed values."""

    start: tuple[float, ...]
    moves: tuple[tuple[float, ...], ...]
    means: tuple[tuple[float, float], ...]
    covariances: tuple[tuple[float, float, float], ...]


def emissions(x: np.ndarray, y: np.ndarray, chain: Chain) -> np.ndarray:
    """Log density of every row under every state."""
    out = []
    for (mx, my), (vxx, vxy, vyy) in zip(chain.means, chain.covariances, strict=True):
        det, dx, dy = vxx * vyy - vxy * vxy, x - mx, y - my
        out.append(-0.5 * ((vyy * dx * dx - 2 * vxy * dx * dy + vxx * dy * dy) / det + np.log(det)) - np.log(2 * np.pi))
    return np.stack(out, axis=1)


def step_matrices(logs: np.ndarray, chain: Chain, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a row multiplies a distribution over states by, and the logarithms taken out of it. The first row of a chain forgets what was before."""
    top = logs.max(axis=1)
    b = np.exp(logs - top[:, None])
    steps = np.array(chain.moves)[None] * b[:, None, :]
    if first and len(steps):
        steps[0] = np.array(chain.start)[None] * b[0][None]
    return steps, top


def product(steps: np.ndarray) -> np.ndarray:
    """The product of step matrices, halved again and again and scaled: multiplication is associative, so any bracketing gives the same."""
    while len(steps) > 1:
        if len(steps) % 2:
            steps = np.concatenate([steps, np.eye(steps.shape[1])[None]])
        steps = steps[0::2] @ steps[1::2]
        steps = steps / steps.max(axis=(1, 2), keepdims=True)
    return steps[0]


def passes(steps: np.ndarray, before: np.ndarray, behind: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, scale) of every row, given the distribution before the first and the weights behind the last row.

    Rows are folded to blocks of ``width``; blocks' products carry the vectors from block to block, then all blocks move on together."""
    n, k = steps.shape[:2]
    blocks = -(-n // width)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(k), (blocks * width - n, k, k))]).reshape(blocks, width, k, k)
    whole = padded[:, 0]
    for t in range(1, width):
        whole = whole @ padded[:, t]
        whole = whole / whole.max(axis=(1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    v, w = before / before.sum(), behind / behind.sum()
    for i in range(blocks):
        into[i] = v
        v = v @ whole[i]
        v = v / v.sum()
    for i in reversed(range(blocks)):
        out[i] = w
        w = whole[i] @ w
        w = w / w.sum()
    forward, backward, scale = np.empty((blocks, width, k)), np.empty((blocks, width, k)), np.empty((blocks, width))
    for t in range(width):
        into = np.einsum("bi,bij->bj", into, padded[:, t])
        scale[:, t] = into.sum(axis=1)
        into = into / scale[:, t, None]
        forward[:, t] = into
    for t in reversed(range(width)):
        backward[:, t] = out
        out = np.einsum("bij,bj->bi", padded[:, t], out)
        out = out / out.sum(axis=1, keepdims=True)
    return forward.reshape(-1, k)[:n], backward.reshape(-1, k)[:n], scale.reshape(-1)[:n]


def expectation(x: np.ndarray, y: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, float]:
    """(each row's state probabilities, expected numbers of moves, log-likelihood) of a whole chain."""
    k = len(chain.start)
    steps, top = step_matrices(emissions(x, y, chain), chain, True)
    forward, backward, scale = passes(steps, np.full(k, 1 / k), np.full(k, 1 / k))
    shares = forward * backward
    pairs = forward[:-1, :, None] * steps[1:] * backward[1:, None, :]
    return shares / shares.sum(axis=1, keepdims=True), (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0), float(np.log(scale).sum() + top.sum())


def maximised(x: np.ndarray, y: np.ndarray, shares: np.ndarray, moves: np.ndarray) -> Chain:
    """The chain under which what was expected is most likely."""
    mass = np.maximum(shares.sum(axis=0), MIN_WEIGHT)
    mx, my = shares.T @ x / mass, shares.T @ y / mass
    dx, dy = x[:, None] - mx, y[:, None] - my
    vxx, vyy = (np.maximum((shares * d * d).sum(axis=0) / mass, MIN_VARIANCE) for d in (dx, dy))
    vxy = (shares * dx * dy).sum(axis=0) / mass
    vxy = np.clip(vxy, -0.999 * np.sqrt(vxx * vyy), 0.999 * np.sqrt(vxx * vyy))
    start, moves = np.maximum(shares[0], MIN_WEIGHT), np.maximum(moves, MIN_WEIGHT)
    return Chain(tuple(start / start.sum()), tuple(map(tuple, moves / moves.sum(axis=1, keepdims=True))), tuple(zip(mx, my, strict=True)), tuple(zip(vxx, vxy, vyy, strict=True)))


def fitted(x: np.ndarray, y: np.ndarray, states: int, iterations: int, tolerance: float) -> tuple[Chain, list[float]]:
    """A chain from thirds (as many bands as states) of ``x`` on, until a row's mean log-likelihood rises by less than ``tolerance``; and the likelihoods met."""
    band = np.searchsorted(np.quantile(x, [i / states for i in range(1, states)]), x)
    shares, moves = np.eye(states)[band], np.ones((states, states))
    np.add.at(moves, (band[:-1], band[1:]), 1)
    chain, past = maximised(x, y, shares, moves), []
    for _ in range(iterations):
        shares, moves, likelihood = expectation(x, y, chain)
        past.append(likelihood)
        if len(past) > 1 and past[-1] - past[-2] < tolerance * len(x):
            break
        chain = maximised(x, y, shares, moves)
    order = sorted(range(states), key=lambda i: -chain.means[i][0])
    pick = lambda v: tuple(v[i] for i in order)
    return Chain(pick(chain.start), tuple(pick(chain.moves[i]) for i in order), pick(chain.means), pick(chain.covariances)), past


def _xy(table: pa.Table, at: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ordered = table.sort_by(at)
    return tuple(ordered.column(c).to_numpy() for c in (at, "x", "y"))


def markov_state(index: DataFrame, settings: RegimeSettings = RegimeSettings(), k: Series = INDICES) -> DataFrame:
    """State (0: highest mean return) and its probability per day, from hidden Markov chains refitted on the past every ``refit_interval`` rows.

    A fit sees only rows before its block; a row's probabilities are those of the forward pass up to the row itself under its own block's chain, so nothing
    later than a row can move its state. All series and refits are fitted side by side, each in a task: its rows are days of one series, which the
    calendar bounds."""
    n, keys, step, iterations, tolerance = settings.n_states, list(k.keys), settings.refit_interval, settings.em_iterations, settings.em_tolerance
    rows = mixture_observations(index, k)
    blocks = refit_blocks(rows, settings.min_train_rows, step, k)
    seen = rows.join(blocks, keys).where(F.col("_pos") < F.col("block_start") + step).select(*keys, "block_start", "date", F.col("_pos").cast("long").alias("_pos"), "x", "y")

    def judged(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        at, x, y = _xy(table, "_pos")
        first = table.column("block_start")[0].as_py()
        chain, _ = fitted(x[at < first], y[at < first], n, iterations, tolerance)
        steps, _ = step_matrices(emissions(x, y, chain), chain, True)
        forward = passes(steps, np.full(n, 1 / n), np.full(n, 1 / n))[0][at >= first]
        own = table.filter(pa.array(at >= first)).select([*keys, "date"])
        return own.append_column("state", pa.array(forward.argmax(axis=1), pa.int32())).append_column("state_prob", pa.array(forward.max(axis=1), pa.float64()))

    schema = T.StructType([*[rows.schema[c] for c in keys], rows.schema["date"], *T.StructType.fromDDL("state int, state_prob double")])
    return seen.groupBy(*keys, "block_start").applyInArrow(judged, schema)


def posteriors(rows: DataFrame, chain: Chain, keys: Sequence[str], order: str = "_pos", size: int = 4096) -> DataFrame:
    """Adds ``filtered`` and ``smoothed`` to every row: the probabilities of all states given the rows up to it, and given the whole series.

    ``rows`` has x, y and a gapless number ``order`` from 0 on in each series. A chain of any length is spread over tasks in blocks of ``size`` rows: each block
    becomes one matrix, a series' few matrices are multiplied up from both ends, and every block then makes its own passes. Nulls in ``x`` or
    ``y`` are an error; an empty table gives no rows."""
    keys, names, k = list(keys), rows.columns, len(chain.start)
    block = [*keys, "_block"]
    dealt = stored(rows.withColumns({"_block": F.floor(F.col(order) / size).cast("long"), "_at": F.col(order).cast("long")}))
    one = T.StructType([*[rows.schema[c] for c in keys], *T.StructType.fromDDL("_block long, m array<double>")])

    def folded(table: pa.Table) -> pa.Table:
        at, x, y = _xy(table, "_at")
        steps, _ = step_matrices(emissions(x, y, chain), chain, at[0] == 0)
        return table.slice(0, 1).select(block).append_column("m", pa.array([product(steps).ravel().tolist()], pa.list_(pa.float64())))

    def carried(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        m = np.array(table.column("m").to_pylist()).reshape(-1, k, k)
        into, behind, v, w = [], [None] * len(m), np.full(k, 1 / k), np.full(k, 1 / k)
        for x in m:
            into.append(v.tolist())
            v = v @ x / (v @ x).sum()
        for i in reversed(range(len(m))):
            behind[i] = w.tolist()
            w = m[i] @ w / (m[i] @ w).sum()
        kind = pa.list_(pa.float64())
        return table.select(block).append_column("_into", pa.array(into, kind)).append_column("_behind", pa.array(behind, kind))

    ends = T.StructType([*one.fields[:-1], *T.StructType.fromDDL("_into array<double>, _behind array<double>")])
    matrices = dealt.groupBy(*block).applyInArrow(folded, one)
    vectors = stored(matrices.groupBy(*keys).applyInArrow(carried, ends))

    def passed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        at, x, y = _xy(table, "_at")
        steps, _ = step_matrices(emissions(x, y, chain), chain, at[0] == 0)
        forward, backward, _ = passes(steps, np.array(table.column("_into")[0].as_py()), np.array(table.column("_behind")[0].as_py()))
        both = forward * backward
        kind = pa.list_(pa.float64())
        return table.select(names).append_column("filtered", pa.array(forward.tolist(), kind)).append_column("smoothed", pa.array((both / both.sum(axis=1, keepdims=True)).tolist(), kind))

    out = T.StructType([*rows.schema, *T.StructType.fromDDL("filtered array<double>, smoothed array<double>")])
    return dealt.join(vectors, block).groupBy(*block).applyInArrow(passed, out)

