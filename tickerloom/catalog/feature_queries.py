"""Window primitives and features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickerloom.catalog import inputs as src
from tickerloom.catalog.registry import query, r
from tickerloom.functions.series import (
    Rolled, Series, apply_stages, expanding_pct_rank, extreme_chain, merge_stages, part_sum_chain, sum_chain, with_ewm, with_rolled)
from tickerloom.operators import cleaning, features as fe
from tickerloom.operators.alignment import align_index_returns
from tickerloom.session import stored

K = cleaning.STOCKS
WINDOWS = ("WINDOW k AS (PARTITION BY ticker ORDER BY date), "
           + ", ".join(f"w{n} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
                       for n in (5, 10, 14, 20, 60, 252)))


def roll(fn: str, x: str, n: int, mp: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER w{n} >= {mp or n} THEN {fn}({x}) OVER w{n} END"


def corr(x: str, y: str, n: int, mp: int) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return (f"CASE WHEN count({a}) OVER w{n} >= {mp} THEN covar_samp({a}, {b}) OVER w{n} / "
            f"nullif(stddev_samp({a}) OVER w{n} * stddev_samp({b}) OVER w{n}, 0) END")


def panel(spark, d):
    return cleaning.derive_bar_columns(src.bars(spark, d))


def index_panel(spark, d, made=None):
    return cleaning.process_index(src.whole_index(spark, d, made))


SQL_STEPS = src.SQL_PANEL + f""",
idx AS (
  SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS index_returns
  FROM (SELECT date, avg(close) AS close FROM bars GROUP BY date)),
f0 AS (
  SELECT panel.*, index_returns, lag(close) OVER k AS pc, close - lag(close) OVER k AS d1,
         high - lag(high) OVER k AS dh, lag(low) OVER k - low AS dl
  FROM panel LEFT JOIN idx USING (date) {WINDOWS}),
f1 AS (
  SELECT *, CASE WHEN d1 > 0 THEN d1 WHEN d1 IS NOT NULL THEN 0.0 END AS gain,
         CASE WHEN d1 < 0 THEN -d1 WHEN d1 IS NOT NULL THEN 0.0 END AS loss,
         greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
         0.5 * ln(high / low) ** 2 - {2 * math.log(2) - 1!r} * ln(close / open) ** 2 AS gk,
         sum(sign(d1) * volume) OVER k AS obv0, (high + low + close) / 3 * volume AS pv,
         CASE WHEN dh > 0 THEN dh WHEN dh IS NOT NULL THEN 0.0 END AS up,
         CASE WHEN dl > 0 THEN dl WHEN dl IS NOT NULL THEN 0.0 END AS down,
         is_limit_up + is_limit_down AS hit FROM f0 {WINDOWS}),
f2 AS (
  SELECT *, CASE WHEN d1 IS NULL THEN NULL ELSE obv0 END AS obv,
         CASE WHEN up > down THEN up ELSE 0.0 END AS pdm, CASE WHEN up > down THEN 0.0 ELSE down END AS mdm,
         {roll('avg', 'tr', 14)} AS atr,
         (volume - {roll('avg', 'volume', 20)}) / nullif({roll('stddev_samp', 'volume', 20)}, 0) * sign(d1) AS z20,
         (volume - {roll('avg', 'volume', 60)}) / nullif({roll('stddev_samp', 'volume', 60)}, 0) * sign(d1) AS z60
  FROM f1 {WINDOWS}),
f3 AS (
  SELECT *, 100 * {roll('avg', 'pdm', 14)} / nullif(atr, 0) AS dip,
         100 * {roll('avg', 'mdm', 14)} / nullif(atr, 0) AS dim FROM f2 {WINDOWS}),
f4 AS (SELECT *, 100 * abs(dip - dim) / nullif(dip + dim, 0) AS dx FROM f3)"""

ALPHA = {s: 2 / (s + 1) for s in (9, 12, 20, 26, 50, 200)}


def _step(s: int, x: str = "n.close") -> str:
    return f"{ALPHA[s]!r} * {x} + {1 - ALPHA[s]!r} * e.e{s}"


SQL_EMA = f""",
n AS MATERIALIZED (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM panel),
e(ticker, date, rn, e12, e26, e20, e50, e200, e9) AS (
  SELECT ticker, date, rn, close, close, close, close, close, 0.0::DOUBLE FROM n WHERE rn = 1
  UNION ALL
  SELECT n.ticker, n.date, n.rn, {_step(12)}, {_step(26)}, {_step(20)}, {_step(50)}, {_step(200)},
         {_step(9, f'(({_step(12)}) - ({_step(26)}))')}
  FROM e JOIN n ON n.ticker = e.ticker AND n.rn = e.rn + 1)"""

ma, sd = (lambda n: roll("avg", "close", n)), (lambda n: roll("stddev_samp", "close", n))
# Feature expressions before the lag, in SQL.
SQL_FEATURES = {
    "rsi_14": f"100 - 100 / (1 + {roll('sum', 'gain', 14)} / nullif({roll('sum', 'loss', 14)}, 0))",
    "macd_line": "e12 - e26", "macd_signal": "e9", "macd_hist": "e12 - e26 - e9",
    **{f"roc_{p}": f"close / lag(close, {p}) OVER k - 1" for p in (5, 10, 20)},
    "stoch_k": f"100 * (close - {roll('min', 'low', 14)}) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0)",
    "atr_14": "atr",
    "boll_pctb": f"(close - ({ma(20)} - 2 * {sd(20)})) / nullif(({ma(20)} + 2 * {sd(20)}) - ({ma(20)} - 2 * {sd(20)}), 0)",
    "gk_vol": f"CASE WHEN {roll('avg', 'gk', 20)} >= 0 THEN sqrt({roll('avg', 'gk', 20)}) END",
    "realized_vol_20": roll("stddev_samp", "returns", 20),
    "obv_z": f"(obv - {roll('avg', 'obv', 60, 20)}) / nullif({roll('stddev_samp', 'obv', 60, 20)}, 0)",
    "vol_ma_ratio": f"volume / nullif({roll('avg', 'volume', 20)}, 0)",
    "vwap_ratio": f"close / nullif({roll('sum', 'pv', 20)} / nullif({roll('sum', 'volume', 20)}, 0), 0)",
    **{f"ema_{s}": f"e{s}" for s in (20, 50, 200)},
    "ema_cross_20_50": "(e20 - e50) / close", "ema_cross_50_200": "(e50 - e200) / close",
    "adx_14": roll("avg", "dx", 14),
    **{f"zscore_{n}": f"(close - {ma(n)}) / nullif({sd(n)}, 0)" for n in (20, 60)},
    "dist_52w_high": f"(close - {roll('max', 'close', 252, 60)}) / {roll('max', 'close', 252, 60)}",
    "dist_52w_low": f"(close - {roll('min', 'close', 252, 60)}) / {roll('min', 'close', 252, 60)}",
    **{f"ret_lag_{x}": "returns" for x in (1, 2, 3, 5, 10, 20)},
    "cb_proximity": "(close - ref_price * 0.93) / (ref_price * 1.07 - ref_price * 0.93)",
    "limit_hit_5d": roll("sum", "hit", 5, 1), "limit_hit_10d": roll("sum", "hit", 10, 1),
    "limit_dir_ratio_10d": f"{roll('sum', 'is_limit_up', 10, 1)}::DOUBLE / nullif({roll('sum', 'hit', 10, 1)}, 0)",
    "intraday_range_ratio": "(high - low) / (0.14 * ref_price)",
    "close_in_range": "(close - low) / nullif(high - low, 0)",
    "ff_proxy_vol_20": roll("avg", "z20", 20, 5), "ff_proxy_vol_60": roll("avg", "z60", 60, 5),
    "index_corr_20": corr("returns", "index_returns", 20, 10), "index_corr_60": corr("returns", "index_returns", 60, 10),
}
FAST_SQL = {**SQL_FEATURES, "gk_vol": f"sqrt(greatest({roll('avg', 'gk', 20)}, 0.0))",
            "ff_proxy_vol_60": roll("avg", "z20", 60, 10)}
FAST_SQL.pop("index_corr_20"), FAST_SQL.pop("index_corr_60")
EMA_FED = ("macd", "ema_")


def _raw(names, table=SQL_FEATURES) -> str:
    """CTE 'raw' with unlagged features."""
    ema = any(n.startswith(EMA_FED) for n in names)
    head = "WITH RECURSIVE " if ema else "WITH "
    frm = "f4 JOIN e USING (ticker, date)" if ema else "f4"
    items = ", ".join(f"{table[n]} AS {n}" for n in names)
    keep = ("ticker, date, f4.* EXCLUDE (ticker, date)" if ema else "f4.*")
    return f"{head}{SQL_STEPS}{SQL_EMA if ema else ''}, raw AS (SELECT {keep}, {items} FROM {frm} {WINDOWS})"


def _shifted(n: str) -> str:
    extra = int(n.rsplit("_", 1)[1]) if n.startswith("ret_lag_") else 1
    return f"lag({n}, {extra}) OVER (PARTITION BY ticker ORDER BY date)"


def feature_sql(names, table=SQL_FEATURES) -> str:
    items = ", ".join(r(f"{_shifted(n)} AS {n}") for n in names)
    return f"{_raw(names, table)} SELECT ticker, date, {items} FROM raw"


def _feature(name: str, sets, names):
    @query(name, feature_sql(names))
    def build(spark, d):
        if any(n.startswith("index_corr") for n in names):
            made = stored(src.bars(spark, d))  # read for the panel and for the index
            df = align_index_returns(cleaning.derive_bar_columns(made), index_panel(spark, d, made))
        else:
            df = panel(spark, d)
        return fe.build(df, sets()).select("ticker", "date", *names)


_feature("fe01_rsi", lambda: [fe.rsi()], ["rsi_14"])
_feature("fe02_macd", lambda: [fe.macd()], ["macd_line", "macd_signal", "macd_hist"])
_feature("fe03_rate_of_change", lambda: [fe.rate_of_change()], ["roc_5", "roc_10", "roc_20"])
_feature("fe04_stochastic_k", lambda: [fe.stochastic_k()], ["stoch_k"])
_feature("fe05_atr", lambda: [fe.atr()], ["atr_14"])
_feature("fe06_bollinger_pct_b", lambda: [fe.bollinger_pct_b()], ["boll_pctb"])
_feature("fe07_garman_klass_vol", lambda: [fe.garman_klass_vol(negative_as_zero=False)], ["gk_vol"])
_feature("fe08_realized_vol", lambda: [fe.realized_vol()], ["realized_vol_20"])
_feature("fe09_obv_z", lambda: [fe.obv_z()], ["obv_z"])
_feature("fe10_volume_ma_ratio", lambda: [fe.volume_ma_ratio()], ["vol_ma_ratio"])
_feature("fe11_vwap_ratio", lambda: [fe.vwap_ratio()], ["vwap_ratio"])
_feature("fe12_ema", lambda: [fe.ema()], ["ema_20", "ema_50", "ema_200"])
_feature("fe13_ema_cross", lambda: [fe.ema_cross()], ["ema_cross_20_50", "ema_cross_50_200"])
_feature("fe14_adx", lambda: [fe.adx()], ["adx_14"])
_feature("fe15_zscore_vs_ma", lambda: [fe.zscore_vs_ma()], ["zscore_20", "zscore_60"])
_feature("fe16_distance_52w", lambda: [fe.distance_from_extremes()], ["dist_52w_high", "dist_52w_low"])
_feature("fe17_lagged_returns", lambda: [fe.lagged_returns()], [f"ret_lag_{x}" for x in (1, 2, 3, 5, 10, 20)])
_feature("fe18_limit_proximity", lambda: [fe.limit_proximity()], ["cb_proximity"])
_feature("fe19_limit_hit_count", lambda: [fe.limit_hit_count()], ["limit_hit_5d", "limit_hit_10d"])
_feature("fe20_limit_direction_ratio", lambda: [fe.limit_direction_ratio()], ["limit_dir_ratio_10d"])
_feature("fe21_intraday_range_ratio", lambda: [fe.intraday_range_ratio()], ["intraday_range_ratio"])
_feature("fe22_close_in_range", lambda: [fe.close_in_range()], ["close_in_range"])
_feature("fe23_flow_proxy", lambda: fe.flow_proxies("full"), ["ff_proxy_vol_20", "ff_proxy_vol_60"])
_feature("fe24_index_correlation", lambda: [fe.index_correlation()], ["index_corr_20", "index_corr_60"])

TECHNICAL = [n for n in SQL_FEATURES if not n.startswith(("cb_", "limit_", "intraday", "close_in", "ff_", "index_"))]
MICRO = ["cb_proximity", "limit_hit_5d", "limit_hit_10d", "limit_dir_ratio_10d", "intraday_range_ratio", "close_in_range"]
FLOW = ["ff_proxy_vol_20", "ff_proxy_vol_60", "index_corr_20", "index_corr_60"]


@query("fe25_construct_target", f"WITH {src.SQL_PANEL}, t AS (SELECT ticker, date, lead(close, 3) OVER "
       f"(PARTITION BY ticker ORDER BY date) / close - 1 AS fwd_return FROM panel) SELECT ticker, date, {r('fwd_return')}, "
       "CASE WHEN fwd_return < -0.015 THEN 1 ELSE 0 END AS label FROM t")
def _target(spark, d):
    return fe.with_target(src.bars(spark, d)).select("ticker", "date", "fwd_return", "label")


@query("fe26_technical_features", feature_sql(TECHNICAL))
def _technical(spark, d):
    return fe.technical_features(panel(spark, d)).select("ticker", "date", *TECHNICAL)


@query("fe26_microstructure_features", feature_sql(MICRO))
def _micro(spark, d):
    return fe.microstructure_features(panel(spark, d)).select("ticker", "date", *MICRO)


@query("fe26_flow_features", feature_sql(FLOW))
def _flow(spark, d):
    return fe.flow_features(panel(spark, d), index_panel(spark, d)).select("ticker", "date", *FLOW)


def matrix_sql(table) -> str:
    names = list(table)
    lagged = ", ".join(f"{_shifted(n)} AS {n}" for n in names)
    fills = ", ".join(f"last_value({n} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date "
                      f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}" for n in names)
    have = " AND ".join(f"{n} IS NOT NULL" for n in names)
    return (f"{_raw(names, table)}, lagged AS (SELECT ticker, date, lead(close, 3) OVER (PARTITION BY ticker ORDER BY date) "
            f"/ close - 1 AS fwd_return, {lagged} FROM raw), filled AS (SELECT ticker, date, fwd_return, {fills} FROM lagged), "
            f"matrix AS (SELECT *, CASE WHEN fwd_return < -0.015 THEN 1 ELSE 0 END AS label FROM filled "
            f"WHERE fwd_return IS NOT NULL AND {have})")


FULL_MATRIX_SQL, FAST_MATRIX_SQL = matrix_sql(SQL_FEATURES), matrix_sql(FAST_SQL)


def matrix(spark, d, mode="full"):
    from tickerloom.config import FeatureSettings

    index = index_panel(spark, d) if mode == "full" else None
    return fe.build_feature_matrix(panel(spark, d), index, FeatureSettings(mode=mode))


@query("fe27_build_feature_matrix",
       f"{FULL_MATRIX_SQL} SELECT ticker, date, label, {r('fwd_return', *SQL_FEATURES)} FROM matrix")
def _matrix(spark, d):
    return matrix(spark, d).select("ticker", "date", "label", "fwd_return", *SQL_FEATURES)


@query("fe27_build_feature_matrix_fast",
       f"{FAST_MATRIX_SQL} SELECT ticker, date, label, {r('fwd_return', *FAST_SQL)} FROM matrix")
def _matrix_fast(spark, d):
    return matrix(spark, d, "fast").select("ticker", "date", "label", "fwd_return", *FAST_SQL)


# window primitives ----------------------------------------------------------------------------------------------
@query("wn01_rolling", f"WITH {src.SQL_PANEL} SELECT ticker, date, " + ", ".join(r(x) for x in (
    f"{roll('avg', 'close', 20)} AS mean_20", f"{roll('stddev_samp', 'close', 20)} AS std_20",
    f"{roll('min', 'low', 14)} AS min_14", f"{roll('max', 'high', 252, 60)} AS max_252",
    f"{roll('sum', 'volume', 60)} AS sum_60", f"{roll('sum', 'is_limit_up', 10, 1)} AS sum_10")) + f" FROM panel {WINDOWS}")
def _rolling(spark, d):
    mean, low, high = sum_chain(K, "close", 20), extreme_chain(K, "min", "low", 14), extreme_chain(K, "max", "high", 252, 60)
    total, ups = sum_chain(K, "volume", 60), part_sum_chain(K, "_u", 10, lead=1)
    df = apply_stages(panel(spark, d), merge_stages(
        [{"_u": F.col("is_limit_up").cast("double"), "std_20": K.rolling("std", "close", 20)}], mean.stages, low.stages,
        high.stages, total.stages, ups.stages))
    return df.select("ticker", "date", (F.col(mean.output) / 20).alias("mean_20"), "std_20", F.col(low.output).alias("min_14"),
                     F.col(high.output).alias("max_252"), F.col(total.output).alias("sum_60"), F.col(ups.output).alias("sum_10"))


@query("wn02_ewm_mean", f"WITH RECURSIVE {src.SQL_PANEL}{SQL_EMA} SELECT ticker, date, {r('e12 AS ewm_12', 'e200 AS ewm_200')} "
       "FROM e")
def _ewm(spark, d):
    return with_ewm(src.bars(spark, d), "close", [12, 200], prefix="ewm").select("ticker", "date", "ewm_12", "ewm_200")


_SHIFT = {"shift_2": (lambda: K.shift("close", 2), "lag(close, 2) OVER k"), "shift_ahead_1": (lambda: K.shift("close", -1), "lead(close) OVER k")}
for _name, _columns in {
    "wn03_shift": _SHIFT,
    "wn04_diff": {"diff_3": (lambda: K.diff("close", 3), "close - lag(close, 3) OVER k")},
    "wn05_pct_change": {"pct_5": (lambda: K.pct_change("close", 5), "close / lag(close, 5) OVER k - 1")},
    "wn06_cumsum": {"cum_volume": (lambda: K.cumsum("volume"), "sum(volume) OVER k")},
    "wn07_cumprod_cummax": {"equity": (lambda: K.cumprod(F.lit(1) + (F.col("close") - 105) / 10000),
                                       "product(1 + (close - 105) / 10000) OVER k"),
                            "top": (lambda: K.cummax("close"), "max(close) OVER k")},
}.items():
    @query(_name, f"WITH {src.SQL_BARS} SELECT ticker, date, "
           + ", ".join(r(f"{s} AS {n}") for n, (_, s) in _columns.items()) + f" FROM bars {WINDOWS}")
    def _primitive(spark, d, columns=_columns):
        return src.bars(spark, d).select("ticker", "date", *[c().alias(n) for n, (c, _) in columns.items()])


@query("wn08_ffill", f"WITH {src.SQL_BARS}, g AS (SELECT ticker, date, CASE WHEN day(date) % 3 = 0 THEN close END AS c FROM bars) "
       f"SELECT ticker, date, {r('last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled')} FROM g")
def _ffill(spark, d):
    gaps = src.bars(spark, d).withColumn("c", F.when(F.dayofmonth("date") % 3 == 0, F.col("close")))
    return gaps.select("ticker", "date", K.ffill("c").alias("filled"))


@query("wn09_rolling_corr", f"WITH {src.SQL_BARS} SELECT ticker, date, {r(corr('close', 'volume', 20, 10) + ' AS corr_20')} "
       f"FROM bars {WINDOWS}")
def _corr(spark, d):
    return with_rolled(src.bars(spark, d).select("ticker", "date", "close", "volume"), {"corr_20": Rolled("close", 20, 10, "volume")}, K).select("ticker", "date", "corr_20")


@query("wn10_expanding_pct_rank", f"WITH {src.SQL_BARS}, n AS (SELECT ticker, date, close, row_number() OVER "
       "(PARTITION BY ticker ORDER BY date) AS rn FROM bars) SELECT a.ticker, a.date, "
       + r("CASE WHEN a.rn >= 60 THEN (count(*) FILTER (b.close < a.close) + (count(*) FILTER (b.close = a.close) + 1) / 2.0) "
           "/ a.rn END AS pct_rank")
       + " FROM n a JOIN n b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY a.ticker, a.date, a.rn, a.close")
def _pct_rank(spark, d):
    return expanding_pct_rank(src.bars(spark, d).select("ticker", "date", "close"), "close", "pct_rank", 60, K).select("ticker", "date", "pct_rank")


def _level():
    return (F.floor(F.col("close")) % 3).cast("int")


@query("wn11_rolling_mode", f"WITH {src.SQL_BARS}, v AS (SELECT ticker, date, CAST(floor(close) AS INTEGER) % 3 AS v FROM bars), "
       "c AS (SELECT ticker, date, count(*) FILTER (v = 0) OVER w5 AS c0, count(*) FILTER (v = 1) OVER w5 AS c1, "
       f"count(*) FILTER (v = 2) OVER w5 AS c2 FROM v {WINDOWS}) SELECT ticker, date, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 "
       "WHEN c1 >= c2 THEN 1 ELSE 2 END AS mode_5 FROM c")
def _mode(spark, d):
    df = src.bars(spark, d).withColumn("v", _level())
    return df.select("ticker", "date", K.rolling_mode("v", 5, (0, 1, 2)).alias("mode_5"))


@query("wn12_rows_since_event", f"WITH {src.SQL_BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn "
       "FROM bars) SELECT ticker, date, rn - max(CASE WHEN close > 104 THEN rn END) OVER (PARTITION BY ticker ORDER BY date) "
       "AS rows_since FROM n")
def _since(spark, d):
    df = apply_stages(src.bars(spark, d), [{"_rn": K.row_number().cast("bigint")},
                                           {"_at": K.ffill(F.when(F.col("close") > 104, F.col("_rn")))}])
    return df.select("ticker", "date", (F.col("_rn") - F.col("_at")).alias("rows_since"))


@query("wn13_lookback_sequences", f"WITH {src.SQL_BARS}, s AS (SELECT ticker, date, close, list(round(close + volume, 2)) OVER "
       "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS seq FROM bars) "
       "SELECT ticker, date, len(seq) AS n, list_extract(seq, 1) AS first_value, list_extract(seq, 20) AS last_value, "
       + r("list_sum(seq) AS total") + ", CASE WHEN close > 105 THEN 1 ELSE 0 END AS label FROM s WHERE len(seq) = 20")
def _sequences(spark, d):
    df = src.bars(spark, d).withColumn("label", F.when(F.col("close") > 105, 1).otherwise(0))
    out = fe.lookback_sequences(df, [F.round(F.col("close") + F.col("volume"), 2)], 20)
    flat = F.transform("sequence", lambda v: v[0])
    return out.select("ticker", "date", F.size("sequence").cast("bigint").alias("n"), flat[0].alias("first_value"),
                      flat[19].alias("last_value"), F.aggregate(flat, F.lit(0.0), lambda a, v: a + v).alias("total"), "label")


@query("wn14_dense_date_rank", f"WITH {src.SQL_BARS} SELECT ticker, date, dense_rank() OVER (ORDER BY date) - 1 AS date_rank FROM bars")
def _date_rank(spark, d):
    from tickerloom.operators.folds import date_ranks

    df = src.bars(spark, d)
    return df.join(date_ranks(df, []), "date").select("ticker", "date", F.col("date_rank").cast("bigint").alias("date_rank"))


@query("va01_leakage_check", f"{FULL_MATRIX_SQL}, tall AS (UNPIVOT (SELECT fwd_return, {', '.join(SQL_FEATURES)} FROM matrix) "
       f"ON {', '.join(SQL_FEATURES)} INTO NAME feature VALUE x), c AS (SELECT feature, count(*) AS n_pairs, "
       "covar_samp(x, fwd_return) / nullif(stddev_samp(x) * stddev_samp(fwd_return), 0) AS corr FROM tall GROUP BY feature) "
       "SELECT feature, n_pairs, round(corr, 6) + 0.0 AS corr, n_pairs >= 50 AND coalesce(abs(corr) > 0.5, false) AS suspicious FROM c")
def _leakage(spark, d):
    from tickerloom.operators.statistics import leakage_check

    return leakage_check(matrix(spark, d), list(SQL_FEATURES))
