"""Window primitives over keyed, ordered series.

A series holds one row per (keys, order) and the order column is a calendar date, so one window group is bounded
by the number of days on the calendar however many raw rows the source has; duplicates are folded before
(``operators.cleaning.dedupe_keep_last`` combines on the map side).

Operators that need several window passes are written as *stages*: dictionaries of new columns, each stage reading
only columns of earlier ones. ``apply_stages`` turns a stage into one projection, so every window of a stage shares
one Window node, and all stages share one shuffle and one sort.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.columns import div

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the plan, executors need no copy of the package

Stage = dict[str, Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Series:
    """How rows form series: partition keys and order column."""

    keys: tuple[str, ...] = ("ticker",)
    order: tuple[str, ...] = ("date",)

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def trailing(self, n: int):
        return self.window.rowsBetween(-(n - 1), 0)

    @property
    def over(self) -> str:
        return f"over (partition by {', '.join(self.keys)} order by {', '.join(self.order)})"

    @property
    def history(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    # shifts ---------------------------------------------------------------------------------------------------
    def shift(self, x, n: int = 1) -> Column:
        if n == 0:
            return _c(x)
        return F.lag(_c(x), n).over(self.window) if n > 0 else F.lead(_c(x), -n).over(self.window)

    def diff(self, x, n: int = 1) -> Column:
        return _c(x) - self.shift(x, n)

    def pct_change(self, x, n: int = 1) -> Column:
        return div(_c(x), self.shift(x, n)) - 1

    # rolling --------------------------------------------------------------------------------------------------
    def rolling(self, how: str, x, n: int, min_periods: int | None = None) -> Column:
        """Trailing ``n`` rows; NULL until ``min_periods`` (default ``n``) values are present. std is ddof=1."""
        aggregate = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}[how]
        frame = self.trailing(n)
        needed = n if min_periods is None else min_periods
        return F.when(F.count(_c(x)).over(frame) >= needed, aggregate(_c(x)).over(frame))

    def rolling_corr(self, x, y, n: int, min_periods: int) -> Column:
        """Pearson on pairwise complete rows; NULL for a constant side (``corr`` would raise under ANSI)."""
        both = _c(x).isNotNull() & _c(y).isNotNull()
        a, b = F.when(both, _c(x)), F.when(both, _c(y))
        frame = self.trailing(n)
        spread = F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame)
        return F.when(F.count(a).over(frame) >= min_periods, div(F.covar_samp(a, b).over(frame), spread))

    def rolling_mode(self, x, n: int, values: Sequence[int]) -> Column:
        """Most frequent of a few known values over the trailing rows, smallest on ties."""
        frame = self.trailing(n)
        counts = [F.count(F.when(_c(x) == v, 1)).over(frame) for v in sorted(values)]
        best = F.greatest(*counts) if len(counts) > 1 else counts[0]
        out = F.when(F.lit(False), F.lit(None).cast("int"))
        for v, n_v in zip(sorted(values), counts):
            out = out.when(n_v == best, F.lit(v))
        return out

    # cumulative -----------------------------------------------------------------------------------------------
    def cumsum(self, x) -> Column:
        return F.when(_c(x).isNotNull(), F.sum(_c(x)).over(self.history))

    def cumprod(self, x) -> Column:
        return F.product(_c(x)).over(self.history)

    def cummax(self, x) -> Column:
        return F.max(_c(x)).over(self.history)

    def ffill(self, x) -> Column:
        return F.last(_c(x), ignorenulls=True).over(self.history)

    def row_number(self) -> Column:
        return F.row_number().over(self.window)

    def lookback(self, vector, n: int) -> Column:
        """The ``n`` rows before the current one as an array, oldest first."""
        return F.collect_list(_c(vector)).over(self.window.rowsBetween(-n, -1))


def apply_stages(df: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    for stage in stages:
        if stage:
            df = df.select("*", *[c.alias(name) for name, c in stage.items()])
    return df


def merge_stages(*plans: Sequence[Stage]) -> list[Stage]:
    """Aligns several stage lists so that equal positions share a projection; equal names must mean equal columns."""
    out: list[Stage] = []
    for plan in plans:
        for i, stage in enumerate(plan):
            if i == len(out):
                out.append({})
            for name, column in stage.items():
                seen = any(name in earlier for earlier in out[: i + 1])
                if not seen:
                    out[i][name] = column
    return out


RADIX = 4


@dataclass
class Chain:
    """Stages that end in one column, ``output``."""

    stages: list[Stage]
    output: str


def ewm_chain(series: Series, name: str, x: str, span: int) -> Chain:
    """Recursive exponential mean y_t = a*x_t + (1-a)*y_{t-1}, y_0 = x_0, with a = 2 / (span + 1).

    Unrolled, y_t is a sum of geometrically weighted terms. One stage adds to every row the weighted partial sums of the
    three blocks before its own, so the reach grows fourfold: 1, 4, 16, 64, ... rows. Stages stop once the weight beyond
    the reach is under 1e-17, less than a double can hold next to the value; their number depends on the span alone,
    never on the data. A stage is three ``lag`` columns over the shared window: no shuffle, no sort, no Python.
    """
    decay = 1.0 - 2.0 / (span + 1.0)
    current = f"_{name}_r0"
    seed = f"case when row_number() {series.over} = 1 then {x} else {1.0 - decay!r}D * {x} end"
    stages: list[Stage] = [{current: F.expr(seed)}]
    reach = 1
    while decay > 0 and decay ** reach >= 1e-17:
        terms = [current] + [f"{decay ** (reach * j)!r}D * coalesce(lag({current}, {reach * j}) {series.over}, 0D)"
                             for j in range(1, RADIX)]
        reach *= RADIX
        current = f"_{name}_r{reach}"
        stages.append({current: F.expr(" + ".join(terms))})
    return Chain(stages, current)


def _lagged(column: str, offset: int, series: Series, default: str = "") -> str:
    return column if offset == 0 else f"lag({column}, {offset}{default}) {series.over}"


def part_sum_chain(series: Series, x: str, n: int, lead: int = 0) -> Chain:
    """``sum_chain`` with rows before the start of the series counted as 0, for windows that may be incomplete."""
    return sum_chain(series, x, n, lead, default=", 0D")


def sum_chain(series: Series, x: str, n: int, lead: int = 0, default: str = "") -> Chain:
    """Trailing sum of ``n`` rows from sums of 4, 16, 64, ... rows: about 3*log4(n) additions per row where a sliding
    frame does ``n``. NULL wherever a row is missing or NULL, which is the full-window rule. Sums of the same column
    share their blocks. ``lead`` is the number of stages before ``x`` exists."""
    size, current, stages = 1, x, [{} for _ in range(lead)]
    blocks = {1: x}
    while size * RADIX <= n:
        wider = f"_{x.lstrip('_')}_s{size * RADIX}"
        stages.append({wider: F.expr(" + ".join(_lagged(current, size * j, series, default) for j in range(RADIX)))})
        size *= RADIX
        current = blocks[size] = wider
    parts, offset = [], 0
    while offset < n:
        while size > n - offset:
            size //= RADIX
        parts.append(_lagged(blocks[size], offset, series, default))
        offset += size
    out = f"_{x.lstrip('_')}_sum{n}"
    stages.append({out: F.expr(" + ".join(parts))})
    return Chain(stages, out)


def extreme_chain(series: Series, how: str, x: str, n: int, min_periods: int | None = None) -> Chain:
    """Trailing ``max`` or ``min`` of a column without gaps, from extremes of 4, 16, 64, ... rows (blocks may overlap)."""
    pick = {"max": "greatest", "min": "least"}[how]
    size, current, stages = 1, x, []
    while size * RADIX <= n:
        wider = f"_{x.lstrip('_')}_{how}{size * RADIX}b"
        stages.append({wider: F.expr(f"{pick}({', '.join(_lagged(current, size * j, series) for j in range(RADIX))})")})
        size *= RADIX
        current = wider
    offsets = sorted({min(o, n - size) for o in range(0, n, size)})
    inner = ", ".join(_lagged(current, o, series) for o in offsets)
    whole = f"{pick}({inner})" if len(offsets) > 1 else inner
    needed = n if min_periods is None else min_periods
    out = f"_{x.lstrip('_')}_{how}{n}"
    stages.append({out: F.expr(f"case when row_number() {series.over} >= {needed} then {whole} end")})
    return Chain(stages, out)


def with_ewm(df: DataFrame, x: str, spans: Sequence[int], series: Series = Series(), prefix: str = "ema") -> DataFrame:
    """Adds ``<prefix>_<span>`` columns."""
    plans = [ewm_chain(series, f"{prefix}{s}", x, s) for s in spans]
    out = apply_stages(df, merge_stages(*[p.stages for p in plans]))
    return out.select(*df.columns, *[F.col(p.output).alias(f"{prefix}_{span}") for p, span in zip(plans, spans)])


@dataclass(frozen=True)
class Rolled:
    """A trailing standard deviation (ddof=1) of ``x`` over ``n`` rows or, with ``y``, the correlation on pairwise complete rows; NULL until
    ``min_periods`` (default ``n``) values are present and, for a correlation, where a side is constant."""

    x: str
    n: int
    min_periods: int | None = None
    y: str | None = None


def _apart(value: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
    """[row, place]: differences from the mean of the known values of each window, 0 where none is known."""
    last = np.maximum.accumulate(np.where(known, np.arange(len(value)), 0))
    before = np.zeros(n - 1)
    inside = np.lib.stride_tricks.sliding_window_view(np.concatenate([before > 0, known]), n)
    apart = np.where(inside, np.lib.stride_tricks.sliding_window_view(np.concatenate([before, value]), n) - value[last][:, None], 0.0)
    return np.where(inside, apart - (apart.sum(axis=1) / np.maximum(inside.sum(axis=1), 1))[:, None], 0.0)


def _rolled(x: np.ndarray, known: np.ndarray, n: int, min_periods: int | None, y: np.ndarray | None = None, y_known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Deviations or correlations of ``Rolled`` and where they are known, from values in order."""
    both = known if y is None else known & y_known
    count = np.convolve(both, np.ones(n, np.int64))[:len(both)]
    fine = (count >= (n if min_periods is None else min_periods)) & (count > 1)
    with np.errstate(all="ignore"):
        a = _apart(x, both, n)
        found = np.sqrt((a * a).sum(axis=1) / (count - 1))
        if y is not None:
            b = _apart(y, both, n)
            spread = found * np.sqrt((b * b).sum(axis=1) / (count - 1))
            fine = fine & (spread != 0)
            found = (a * b).sum(axis=1) / (count - 1) / spread
    return found, fine


def with_rolled(df: DataFrame, rolled: dict[str, Rolled], series: Series) -> DataFrame:
    """Adds the columns of ``rolled``, read from columns of ``df``.

    A series is read once, in order, by its task, which the calendar bounds like a window group. A window's values are taken against its last known
    one, then against their mean: no digits are lost to a level far from zero, and a constant window's deviation is exactly 0."""
    if not rolled:
        return df
    order, sources = list(series.order), sorted({c for r in rolled.values() for c in (r.x, r.y) if c})
    schema = T.StructType([*df.schema, *(T.StructField(name, T.DoubleType()) for name in rolled)])

    def added(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_start"))
        known = {c: table[f"_of_{c}"].is_valid().to_numpy() for c in sources}
        values = {c: pc.fill_null(table[f"_of_{c}"], 0.0).to_numpy() for c in sources}
        table = table.drop_columns([f"_of_{c}" for c in sources])
        for name, r in rolled.items():
            found, fine = _rolled(values[r.x], known[r.x], r.n, r.min_periods, *((values[r.y], known[r.y]) if r.y else ()))
            table = table.append_column(name, pa.array(found, pa.float64(), mask=~fine, from_pandas=False))
        return table

    told = df.select("*", *[F.col(c).cast("double").alias(f"_of_{c}") for c in sources])
    return told.groupBy(*series.keys).applyInArrow(added, schema)


def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, missing where b is missing or 0."""
    return a / np.where(b == 0, np.nan, b)


class Held:
    """The rows of one series, in order, that a task holds: columns as doubles, NaN for NULL, and what was computed from them by name.

    Sums, extremes and exponential means are built from blocks of 4, 16, 64, ... rows as the chains above are, in the same order of additions."""

    def __init__(self, table: pa.Table):
        self.table, self.n = table, len(table)
        self.held: dict[str, np.ndarray] = {}

    def __getitem__(self, column: str) -> np.ndarray:
        return self.once(column, lambda: pc.cast(self.table[column], pa.float64()).to_numpy())

    def once(self, name: str, of) -> np.ndarray:
        if name not in self.held:
            self.held[name] = of()
        return self.held[name]

    def lag(self, x: np.ndarray, n: int, before: float = np.nan) -> np.ndarray:
        """The value ``n`` rows back, ``before`` where there is no such row."""
        if n == 0:
            return x
        out = np.full(self.n, before)
        out[n:] = x[:max(self.n - n, 0)]
        return out

    def diff(self, column: str) -> np.ndarray:
        return self.once(f"diff {column}", lambda: self[column] - self.lag(self[column], 1))

    def change(self, column: str, n: int) -> np.ndarray:
        return quotient(self[column], self.lag(self[column], n)) - 1

    def filled(self, x: np.ndarray) -> np.ndarray:
        """Each row's last known value."""
        return x[np.maximum.accumulate(np.where(np.isnan(x), 0, np.arange(self.n)))]

    def sum(self, name: str, of, n: int, before: float = np.nan) -> np.ndarray:
        """``sum_chain`` or, with ``before`` 0, ``part_sum_chain`` of a named column; ``of`` makes it (a column of the rows if None)."""
        return self.once(f"sum {n} {before} {name}", lambda: self._sum(name, of, n, before))

    def _sum(self, name: str, of, n: int, before: float) -> np.ndarray:
        current, size = self.once(name, of) if of else self[name], 1
        blocks = {1: current}
        while size * RADIX <= n:
            wider = current
            for j in range(1, RADIX):
                wider = wider + self.lag(current, size * j, before)
            size *= RADIX
            current = blocks[size] = wider
        out, offset = None, 0
        while offset < n:
            while size > n - offset:
                size //= RADIX
            part = self.lag(blocks[size], offset, before)
            out, offset = part if out is None else out + part, offset + size
        return out

    def mean(self, column: str, n: int) -> np.ndarray:
        return self.sum(column, None, n) / float(n)

    def extreme(self, how: str, column: str, n: int, min_periods: int | None = None) -> np.ndarray:
        """``extreme_chain``."""
        return self.once(f"{how} {n} {min_periods} {column}", lambda: self._extreme(how, column, n, min_periods))

    def _extreme(self, how: str, column: str, n: int, min_periods: int | None) -> np.ndarray:
        pick = {"max": np.fmax, "min": np.fmin}[how]
        current, size = self[column], 1
        while size * RADIX <= n:
            wider = current
            for j in range(1, RADIX):
                wider = pick(wider, self.lag(current, size * j))
            current, size = wider, size * RADIX
        out = current
        for offset in sorted({min(o, n - size) for o in range(0, n, size)}):
            out = pick(out, self.lag(current, offset))
        return np.where(np.arange(1, self.n + 1) >= (n if min_periods is None else min_periods), out, np.nan)

    def ewm(self, name: str, of, span: int) -> np.ndarray:
        """``ewm_chain``."""
        return self.once(f"ewm {span} {name}", lambda: self._ewm(self.once(name, of) if of else self[name], span))

    def _ewm(self, x: np.ndarray, span: int) -> np.ndarray:
        decay = 1.0 - 2.0 / (span + 1.0)
        current, reach = (1.0 - decay) * x, 1
        current[:1] = x[:1]
        while decay > 0 and decay ** reach >= 1e-17 and reach < self.n:  # beyond the series there is nothing to add
            known, wider = np.where(np.isnan(current), 0.0, current), current
            for j in range(1, RADIX):
                wider = wider + decay ** (reach * j) * self.lag(known, reach * j, 0.0)
            current, reach = wider, reach * RADIX
        return current

    def known_mean(self, name: str, n: int, min_periods: int) -> np.ndarray:
        """Trailing mean of the known values; missing until ``min_periods`` are."""
        x = self[name]
        known = ~np.isnan(x)
        count = np.convolve(known, np.ones(n, np.int64))[:self.n]
        total = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1), np.where(known, x, 0.0)]), n).sum(axis=1)
        return np.where(count >= min_periods, quotient(total, count.astype(float)), np.nan)

    def _of(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        known = ~np.isnan(self[name])
        return np.where(known, self[name], 0.0), known

    def std(self, name: str, n: int, min_periods: int | None = None) -> np.ndarray:
        """The trailing deviation of ``Rolled``."""
        return self.once(f"std {n} {min_periods} {name}", lambda: (lambda found, fine: np.where(fine, found, np.nan))(*_rolled(*self._of(name), n, min_periods)))

    def correlation(self, x: str, y: str, n: int, min_periods: int) -> np.ndarray:
        found, fine = _rolled(*self._of(x), n, min_periods, *self._of(y))
        return np.where(fine, found, np.nan)


def expanding_pct_rank(df: DataFrame, x: str, out: str, min_periods: int, series: Series) -> DataFrame:
    """Average rank of each value within its own history, divided by the history's length.

    A series is read once, in order, by its task, which the calendar bounds like a window group: each value's place in the sorted list of
    those before it counts the smaller and the equal ones. Rows are shuffled once, by key. A row whose key or order is null gets null."""
    order, named = list(series.order), [*series.keys, *series.order]
    schema = T.StructType([*(df.schema[c] for c in named), *(f for f in df.schema.fields if f.name not in named), T.StructField(out, T.DoubleType())])

    def ranked(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_start")).select(schema.names[:-1])
        known = np.flatnonzero(table[x].is_valid().to_numpy())
        value = np.unique(table[x].drop_null().to_numpy(), return_inverse=True)[1].tolist()
        seen: list[int] = []
        found = np.full(len(table), np.nan)
        for n, (at, v) in enumerate(zip(known.tolist(), value, strict=True), 1):
            below, upto = bisect_left(seen, v), bisect_right(seen, v)
            seen.insert(upto, v)
            if n >= min_periods:
                found[at] = (below + (upto - below + 2) / 2.0) / n  # below + (equal including the row itself + 1) / 2
        for c in named:
            found[table[c].is_null().to_numpy()] = np.nan
        return table.append_column(out, pa.array(found, pa.float64(), from_pandas=True))

    return df.groupBy(*series.keys).applyInArrow(ranked, schema)
