"""Mean shifts as the optimum of a penalised cost, by dynamic programming with pruning."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.config import RegimeSettings
from tickerloom.functions.series import Series
from tickerloom.operators.cleaning import INDICES
from tickerloom.operators.regime import _numbered, flag_changes, refit_blocks
from tickerloom.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan, executors need no copy of the package


def optimal_prefixes(values: np.ndarray, size: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """For every prefix length t the least cost (squared deviation of segments of at least ``size``, plus ``penalty`` for each break) and where its last
    segment begins; without a whole segment the cost is infinite.

    A start s that is beaten by a break at t can never win from t + size on, when a segment from t is long enough, so it is dropped then."""
    n = len(values)
    one, two = np.append(0.0, np.cumsum(values)), np.append(0.0, np.cumsum(values * values))
    cost, last, dead = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.full(n + 1, n + 1, np.int64)
    cost[0] = -penalty
    starts = np.zeros(0, np.int64)
    for t in range(size, n + 1):
        fresh = t - size
        starts = starts[dead[starts] > t]
        if np.isfinite(cost[fresh]):
            starts = np.append(starts, fresh)
        if not len(starts):
            continue
        sums = one[t] - one[starts]
        whole = cost[starts] + (two[t] - two[starts] - sums * sums / (t - starts))
        best = int(np.argmin(whole))
        cost[t], last[t] = whole[best] + penalty, starts[best]
        dead[starts] = np.where(whole >= cost[t], np.minimum(dead[starts], t + size), dead[starts])
    return cost, last


def breaks_of(last: np.ndarray, t: int) -> list[int]:
    """The breaks of the optimum over the first t values, ascending."""
    out = []
    while last[t] > 0:
        t = int(last[t])
        out.append(t)
    return out[::-1]


def optimal_fits(index: DataFrame, settings: RegimeSettings = RegimeSettings(), k: Series = INDICES, value: str = "returns") -> DataFrame:
    """(series, block_start, breaks, cost) of the optimum over the rows before every block.

    The fits of a series are its prefixes, and the dynamic programme over the whole series solves all of them on its way: one pass for each series
    in a task of its own, as its rows are bounded by the calendar."""
    keys, size, penalty = list(k.keys), settings.changepoint_min_size, settings.changepoint_penalty
    rows = _numbered(index.where(F.col(value).isNotNull()), [value], k)
    blocks = refit_blocks(rows, settings.min_train_rows, settings.refit_interval, k).groupBy(*keys).agg(F.collect_set("block_start").alias("_starts"))

    def solved(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        cost, last = optimal_prefixes(table.column(value).to_numpy(), size, penalty)
        starts = sorted(table.column("_starts")[0].as_py())
        head = table.slice(0, 1).select(keys)
        out = pa.concat_tables([head] * len(starts))
        return out.append_column("block_start", pa.array(starts, pa.int32())).append_column("breaks", pa.array([breaks_of(last, t) for t in starts], pa.list_(pa.int32()))).append_column(
            "cost", pa.array([cost[t] for t in starts], pa.float64()))

    schema = T.StructType([*[rows.schema[c] for c in keys], *T.StructType.fromDDL("block_start int, breaks array<int>, cost double")])
    return rows.join(blocks, keys).groupBy(*keys).applyInArrow(solved, schema)


def optimal_changepoints(index: DataFrame, settings: RegimeSettings = RegimeSettings(), k: Series = INDICES) -> DataFrame:
    """``regime.changepoints`` with the breaks of least penalised cost in place of the greedy ones."""
    found = stored(optimal_fits(index, settings, k))
    last = found.where(F.size("breaks") > 0).select(*k.keys, "block_start", F.element_at("breaks", -1).alias("_last"))
    rows = _numbered(index.where(F.col("returns").isNotNull()), ["returns"], k).select(*k.keys, "date", "_pos")
    return flag_changes(rows, last, settings, k)
