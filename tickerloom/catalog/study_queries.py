"""Regimes, folds, metrics, statistics and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog import inputs as src
from tickerloom.catalog.feature_queries import FULL_MATRIX_SQL, SQL_FEATURES, matrix
from tickerloom.catalog.panel_queries import (
    DEFAULT_FOLDS_SQL, SQL_CDF, SQL_SCORES, regime_table)
from tickerloom.catalog.registry import query, r
from tickerloom.config import FoldSettings, RegimeSettings
from tickerloom.functions.columns import hash_uniform, poisson_one_cdf
from tickerloom.operators import alignment as al, cleaning as cl, folds as fo, markov as mk, metrics as me, models as mo, regime as rg, segmentation as sg
from tickerloom.operators import reports as rp, statistics as st
from tickerloom.session import new_folder, removed, stored, stored_rounded

# regimes --------------------------------------------------------------------------------------------------------
W60 = "(PARTITION BY series_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
K_ = "(PARTITION BY series_id ORDER BY date)"


def index(spark, d):
    return cl.process_index(src.index_bars(spark, d))


SQL_TREND = src.SQL_INDEX + """,
ni AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM index_panel),
te(series_id, date, rn, close, ema) AS (
  SELECT series_id, date, rn, close, close FROM ni WHERE rn = 1 UNION ALL
  SELECT ni.series_id, ni.date, ni.rn, ni.close, 2 / 201.0 * ni.close + (1 - 2 / 201.0) * te.ema
  FROM te JOIN ni ON ni.series_id = te.series_id AND ni.rn = te.rn + 1)"""
SQL_VOL = f""",
vol AS (SELECT series_id, date, CASE WHEN count(returns) OVER w >= 20 THEN stddev_samp(returns) OVER w END AS v FROM ni WINDOW w AS {W60}),
nv AS (SELECT *, row_number() OVER {K_} AS rn FROM vol WHERE v IS NOT NULL),
pr AS (SELECT a.series_id, a.date, a.rn, (count(*) FILTER (b.v < a.v) + (count(*) FILTER (b.v = a.v) + 1) / 2.0) / a.rn AS p
       FROM nv a JOIN nv b ON a.series_id = b.series_id AND b.rn <= a.rn GROUP BY a.series_id, a.date, a.rn),
rules AS (SELECT te.series_id, te.date, CASE WHEN te.close > ema THEN 0 ELSE 2 END AS trend,
                 CASE WHEN pr.rn >= 60 AND p > 0.8 THEN 1 ELSE 0 END AS vol_high FROM te LEFT JOIN pr USING (series_id, date))"""
RULE = "CASE WHEN trend = 0 AND vol_high = 0 THEN 0 WHEN trend = 2 AND vol_high = 1 THEN 2 ELSE 1 END"


@query("rg01_ema_trend", f"WITH RECURSIVE {SQL_TREND} SELECT series_id, date, CASE WHEN close > ema THEN 0 ELSE 2 END AS trend FROM te")
def _trend(spark, d):
    return rg.ema_trend(index(spark, d)).select("series_id", "date", "trend")


@query("rg02_volatility_flag", f"WITH RECURSIVE {SQL_TREND}{SQL_VOL} SELECT series_id, date, vol_high FROM rules")
def _vol(spark, d):
    return rg.volatility_flag(index(spark, d)).select("series_id", "date", "vol_high")


@query("rg03_rule_regime", f"WITH RECURSIVE {SQL_TREND}{SQL_VOL} SELECT series_id, date, trend, vol_high, {RULE} AS rule_regime FROM rules")
def _rules(spark, d):
    return rg.rule_regime(index(spark, d)).select("series_id", "date", "trend", "vol_high", "rule_regime")


# Index returns here are averages of many tickers; the penalty is set to their scale.
REGIME = RegimeSettings(changepoint_penalty=0.003)


@query("rg04_mixture_state")
def _states(spark, d):
    return rg.mixture_state(index(spark, d), REGIME)


@query("rg04_markov_state")
def _markov(spark, d):
    return mk.markov_state(index(spark, d))


#: A stated chain: steep and calm days, each state likely to stay.
CHAIN = mk.Chain((0.5, 0.3, 0.2), ((0.9, 0.07, 0.03), (0.05, 0.9, 0.05), (0.02, 0.08, 0.9)), ((0.4, 0.9), (0.0, 1.1), (-0.5, 1.4)), ((0.6, 0.05, 0.2), (0.9, -0.1, 0.3), (1.4, 0.2, 0.5)))


def _chain_sql(c: mk.Chain) -> str:
    """Both passes row by row: the forward one up the positions, the backward one down."""
    def density(i):
        (mx, my), (a, b, d) = c.means[i], c.covariances[i]
        return f"exp(-0.5 * (({d} * (x - {mx}) * (x - {mx}) - 2 * {b} * (x - {mx}) * (y - {my}) + {a} * (y - {my}) * (y - {my})) / {a * d - b * b} + ln({a * d - b * b})))"

    k = range(3)
    into = [" + ".join(f"f{i} * {c.moves[i][j]}" for i in k) for j in k]
    back = [" + ".join(f"{c.moves[i][j]} * e{j} * g{j}" for j in k) for i in k]
    return f"""{src.SQL_INDEX},
vol AS (SELECT series_id, date, returns, stddev_samp(returns) OVER w AS v, count(returns) OVER w AS c FROM index_panel WHERE returns IS NOT NULL
        WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ob AS (SELECT series_id, date, returns * 100 AS x, v * 100 AS y, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos FROM vol WHERE c >= 10 AND v IS NOT NULL),
em AS MATERIALIZED (SELECT series_id, date, pos, {', '.join(f'{density(i)} AS e{i}' for i in k)} FROM ob),
fw AS (
  SELECT series_id, pos, {', '.join(f'{c.start[i]} * e{i} / ({" + ".join(f"{c.start[j]} * e{j}" for j in k)}) AS f{i}' for i in k)} FROM em WHERE pos = 0
  UNION ALL SELECT series_id, pos, {', '.join(f'u{i} / (u0 + u1 + u2)' for i in k)} FROM (
    SELECT em.series_id, em.pos, {', '.join(f'({into[j]}) * e{j} AS u{j}' for j in k)} FROM fw JOIN em ON em.series_id = fw.series_id AND em.pos = fw.pos + 1)),
bw AS (
  SELECT series_id, max(pos) AS pos, 1.0::DOUBLE AS g0, 1.0::DOUBLE AS g1, 1.0::DOUBLE AS g2 FROM em GROUP BY series_id
  UNION ALL SELECT series_id, pos - 1, {', '.join(f'u{i} / (u0 + u1 + u2)' for i in k)} FROM (
    SELECT em.series_id, em.pos, {', '.join(f'{back[i]} AS u{i}' for i in k)} FROM bw JOIN em ON em.series_id = bw.series_id AND em.pos = bw.pos) WHERE pos > 0)"""


@query("rg04_markov_posteriors", f"WITH RECURSIVE {_chain_sql(CHAIN)} SELECT em.series_id, em.date, " + r(*[f"f{i} AS filtered_{i}" for i in range(3)], *[f"f{i} * g{i} / (f0 * g0 + f1 * g1 + f2 * g2) AS smoothed_{i}" for i in range(3)])
       + " FROM em JOIN fw ON fw.series_id = em.series_id AND fw.pos = em.pos JOIN bw ON bw.series_id = em.series_id AND bw.pos = em.pos")
def _posteriors(spark, d):
    found = mk.posteriors(rg.mixture_observations(index(spark, d)), CHAIN, ["series_id"], size=500)
    return found.select("series_id", "date", *[F.col(c)[i].alias(f"{c}_{i}") for c in ("filtered", "smoothed") for i in range(3)])


def _thirds(spark, d):
    """Components of three return bands per series, in no particular order."""
    rows = index(spark, d).where(F.col("returns").isNotNull())
    band = F.dayofyear("date") % 3
    parts = rows.groupBy("series_id").agg(*[F.avg(F.when(band == i, F.col("returns"))).alias(f"m{i}") for i in range(3)])
    return parts.select("series_id", *[F.struct(F.col(f"m{i}").alias("mx")).alias(f"c{i}") for i in range(3)])


@query("rg05_relabel_by_return", f"WITH {src.SQL_INDEX}, b AS (SELECT series_id, dayofyear(date) % 3 AS band, avg(returns) AS m FROM index_panel "
       f"WHERE returns IS NOT NULL GROUP BY ALL), s AS (SELECT series_id, list(m ORDER BY m DESC) AS l FROM b GROUP BY series_id) SELECT series_id, {r('l[1] AS best', 'l[2] AS mid', 'l[3] AS worst')} FROM s")
def _relabel(spark, d):
    out = rg.relabel_by_return(_thirds(spark, d), ["series_id"])
    return out.select("series_id", F.col("c0.mx").alias("best"), F.col("c1.mx").alias("mid"), F.col("c2.mx").alias("worst"))


def shifted(index_rows):
    """Index returns whose mean steps up and down with the year, so that there are shifts to find."""
    return index_rows.withColumn("returns", F.col("returns") + F.when(F.year("date") % 2 == 0, 1 / 64).otherwise(0.0))


def _changepoint_sql(depth: int = 10, size: int = 20, penalty: float = 0.003) -> str:
    """Segments as (a, c, pa, pc) rows, split level by level."""
    sql = src.SQL_INDEX + """,
cpos AS MATERIALIZED (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos,
                sum(returns + CASE WHEN year(date) % 2 = 0 THEN 0.015625::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY series_id ORDER BY date) AS s FROM index_panel WHERE returns IS NOT NULL),
blk AS (SELECT series_id, unnest(range(252, n, 60)) AS bs FROM (SELECT series_id, count(*) AS n FROM cpos GROUP BY series_id)),
seg0 AS (SELECT blk.series_id, bs, 0::BIGINT AS a, bs AS c, 0.0::DOUBLE AS pa, s AS pc FROM blk JOIN cpos ON cpos.series_id = blk.series_id AND pos = bs - 1)"""
    for i in range(depth):
        sql += f""",
cut{i} AS MATERIALIZED (
  SELECT series_id, bs, a, c, pa, pc, b, pb FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, bs, a ORDER BY gain DESC, b) AS rk FROM (
      SELECT g.*, p.pos + 1 AS b, p.s AS pb,
             pow(p.s - pa, 2) / (p.pos + 1 - a) + pow(pc - p.s, 2) / (c - (p.pos + 1)) - pow(pc - pa, 2) / (c - a) AS gain
      FROM seg{i} g JOIN cpos p ON p.series_id = g.series_id AND p.pos + 1 - a >= {size} AND c - (p.pos + 1) >= {size}))
  WHERE rk = 1 AND gain > {penalty}),
seg{i + 1} AS (SELECT series_id, bs, a, b AS c, pa, pb AS pc FROM cut{i} UNION ALL SELECT series_id, bs, b, c, pb, pc FROM cut{i})"""
    cuts = " UNION ALL ".join(f"SELECT series_id, bs, b FROM cut{i}" for i in range(depth))
    return sql + f""",
lastcut AS (SELECT series_id, bs, max(b) AS lc FROM ({cuts}) GROUP BY ALL),
news AS (SELECT *, coalesce(lc <> lag(lc) OVER (PARTITION BY series_id ORDER BY bs), true) AS isnew FROM lastcut),
owned AS (SELECT *, CASE WHEN pos >= 252 THEN 252 + ((pos - 252) // 60) * 60 END AS bs FROM cpos),
cps AS (SELECT o.series_id, o.date, CASE WHEN pos >= 252 AND pos = o.bs AND isnew THEN 1 ELSE 0 END AS cp_flag,
               CASE WHEN pos < 252 THEN 0.0 ELSE (pos - coalesce(lc, 252))::DOUBLE END AS days_since_cp
        FROM owned o LEFT JOIN news n ON n.series_id = o.series_id AND n.bs = o.bs)"""


@query("rg06_changepoints", f"WITH {_changepoint_sql()} SELECT series_id, date, cp_flag, {r('days_since_cp')} FROM cps")
def _changepoints(spark, d):
    return rg.changepoints(shifted(index(spark, d)), REGIME)


def _optimal_sql(size: int = 20, penalty: float = 0.003) -> str:
    """The same programme without pruning: one step for each row, the costs of all prefixes in a list."""
    return f"""{src.SQL_INDEX},
v AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date) AS t, returns + CASE WHEN year(date) % 2 = 0 THEN 0.015625::DOUBLE ELSE 0.0::DOUBLE END AS x FROM index_panel WHERE returns IS NOT NULL),
s AS MATERIALIZED (SELECT series_id, t, sum(x) OVER w AS a, sum(x * x) OVER w AS b, count(*) OVER (PARTITION BY series_id) AS n FROM v WINDOW w AS (PARTITION BY series_id ORDER BY t)),
dp AS (
  SELECT DISTINCT series_id, 0::BIGINT AS t, [{{'s': 0::BIGINT, 'f': -{penalty}::DOUBLE, 'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}}] AS done, 0.0::DOUBLE AS cost, 0::BIGINT AS last FROM s
  UNION ALL
  SELECT series_id, t, list_append(done, {{'s': t, 'f': best.f, 'a': a, 'b': b}}), best.f, best.s FROM (
    SELECT dp.series_id, s.t, dp.done, s.a, s.b, coalesce(list_min(list_transform(list_filter(dp.done[1:greatest(s.t - {size} + 1, 0)], lambda q: q.f IS NOT NULL),
             lambda q: {{'f': q.f + (s.b - q.b - (s.a - q.a) * (s.a - q.a) / (s.t - q.s)) + {penalty}, 's': q.s}})), {{'f': NULL, 's': 0}}) AS best
    FROM dp JOIN s ON s.series_id = dp.series_id AND s.t = dp.t + 1))
SELECT series_id, CAST(t AS INTEGER) AS block_start, CAST(last AS INTEGER) AS last_break, {r('cost')} FROM dp WHERE t >= 252 AND (t - 252) % 60 = 0 AND t < (SELECT max(n) FROM s WHERE s.series_id = dp.series_id)"""


@query("rg06_changepoints_optimal", f"WITH RECURSIVE {_optimal_sql()}")
def _optimal(spark, d):
    """The optimum over the rows before every block: its cost and last break."""
    found = sg.optimal_fits(shifted(index(spark, d)), REGIME)
    return found.select("series_id", "block_start", F.when(F.size("breaks") > 0, F.element_at("breaks", -1)).otherwise(0).alias("last_break"), "cost")


def _plain_states(spark, d):
    """State table from plain arithmetic, so that the combination rule can be checked on its own."""
    i = index(spark, d)
    return i.where(F.dayofmonth("date") % 4 != 0).select("series_id", "date", (F.dayofyear("date") % 3).alias("state"),
                                                         hash_uniform("series_id", "date").alias("state_prob"))


SQL_HYBRID = f"{SQL_TREND}{SQL_VOL}, " + _changepoint_sql().split("index_panel AS", 1)[1].split("),", 1)[1].lstrip() + f""",
states AS (SELECT series_id, date, dayofyear(date) % 3 AS state, ('0x' || substr(md5(series_id || '|' || date), 1, 8))::BIGINT / 4294967296.0 AS state_prob
           FROM index_panel WHERE day(date) % 4 <> 0),
hybrid AS (SELECT series_id, date, cp_flag, CASE WHEN {RULE} = 0 AND (state IS NULL OR state_prob < 0.7) THEN 0
  WHEN {RULE} = 2 AND (state IS NULL OR state_prob < 0.7) THEN 2 ELSE coalesce(state, 1) END::INTEGER AS regime
  FROM states FULL JOIN cps USING (series_id, date) FULL JOIN rules USING (series_id, date))"""


def hybrid(spark, d):
    i = index(spark, d)
    rules = rg.rule_regime(i).select("series_id", "date", "rule_regime")
    return rg.hybrid_regime(_plain_states(spark, d), rg.changepoints(shifted(i), REGIME), rules)


@query("rg07_hybrid_regime", f"WITH RECURSIVE {SQL_HYBRID} SELECT series_id, date, cp_flag, regime FROM hybrid")
def _hybrid(spark, d):
    return hybrid(spark, d).select("series_id", "date", "cp_flag", "regime")


SQL_PLAIN = src.SQL_INDEX + ", plain AS (SELECT series_id, date, CAST((dayofyear(date) // 4) % 3 AS INTEGER) AS regime FROM index_panel)"


def _plain_regime(spark, d):
    return index(spark, d).select("series_id", "date", (F.floor(F.dayofyear("date") / 4) % 3).cast("int").alias("regime"))


@query("rg08_regime_shift_flag", f"WITH {SQL_PLAIN}, c AS (SELECT *, count(*) FILTER (regime = 0) OVER w AS c0, count(*) FILTER (regime = 1) OVER w AS c1, "
       f"count(*) FILTER (regime = 2) OVER w AS c2 FROM plain WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) "
       "SELECT series_id, date, regime, CAST(regime <> CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS INTEGER) AS shift_flag FROM c")
def _shift(spark, d):
    return rg.regime_shift_flag(_plain_regime(spark, d))


@query("rg09_regime_runs", f"WITH {SQL_PLAIN}, g AS (SELECT *, row_number() OVER {K_} - row_number() OVER (PARTITION BY series_id, regime ORDER BY date) AS island FROM plain) "
       "SELECT series_id, regime, min(date) AS start_date, max(date) AS end_date, count(*) AS n_rows FROM g GROUP BY series_id, regime, island")
def _runs(spark, d):
    return rg.regime_runs(_plain_regime(spark, d)).drop("run")


# folds ----------------------------------------------------------------------------------------------------------
@query("wf01_generate_folds", f"WITH {src.SQL_BARS}, {DEFAULT_FOLDS_SQL} SELECT * FROM folds")
def _folds(spark, d):
    return fo.folds_frame(spark, fo.data_folds(src.bars(spark, d)))


QUICK = FoldSettings(36, 12, 12)
SQL_QUICK = DEFAULT_FOLDS_SQL.replace("60 + 3 *", "36 + 12 *").replace("INTERVAL 6 MONTH", "INTERVAL 12 MONTH")
SQL_TRAIN = f"{SQL_SCORES}, {SQL_QUICK}, train AS (SELECT fold, date, ticker, close FROM bars JOIN folds ON date BETWEEN train_start AND train_end)"


def _train(spark, d):
    b = src.bars(spark, d).select("date", "ticker", "close")
    return al.assign_folds(b, fo.data_folds(b, QUICK)).where("part = 'train'").drop("part")


@query("wf02_train_valid_split", f"WITH {SQL_TRAIN}, n AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY date DESC, ticker DESC) AS rn, count(*) OVER "
       "(PARTITION BY fold) AS n FROM train) SELECT fold, date, ticker, rn <= greatest(floor(n * 0.2), 50) AS is_valid FROM n")
def _split(spark, d):
    return fo.train_valid_split(_train(spark, d)).select("fold", "date", "ticker", "is_valid")


@query("wf03_current_regime", f"WITH {SQL_SCORES}, {SQL_QUICK}, asked AS (SELECT DISTINCT fold, date FROM bars JOIN folds ON date BETWEEN test_start AND test_end), "
       "c AS (SELECT fold, regime, count(*) AS n FROM asked JOIN regime_tab USING (date) GROUP BY ALL) SELECT fold, arg_min(regime, (-n, regime)) AS current_regime FROM c GROUP BY fold")
def _current(spark, d):
    b = src.bars(spark, d)
    tests = al.assign_folds(b.select("date"), fo.data_folds(b, QUICK)).where("part = 'test'").select("fold", "date").distinct()
    return fo.current_regime(tests.join(regime_table(spark, d), "date"))


@query("wf04_time_decay_weights", f"WITH {SQL_TRAIN}, q AS (SELECT *, dense_rank() OVER (PARTITION BY fold ORDER BY date) AS dr FROM train), "
       "w AS (SELECT *, pow(0.997, max(dr) OVER (PARTITION BY fold) - dr) AS raw FROM q) "
       f"SELECT fold, date, ticker, {r('raw / avg(raw) OVER (PARTITION BY fold) AS weight')} FROM w")
def _decay(spark, d):
    return fo.time_decay_weights(_train(spark, d)).select("fold", "date", "ticker", "weight")


@query("wf05_regime_filter", f"WITH {SQL_TRAIN}, t AS (SELECT train.*, coalesce(regime, 1) AS regime FROM train LEFT JOIN regime_tab USING (date)), "
       "c AS (SELECT *, fold % 3 AS cur, count(*) FILTER (regime = fold % 3) OVER (PARTITION BY fold) AS hits FROM t) "
       "SELECT fold, date, ticker, regime FROM c WHERE hits < 50 OR regime = cur")
def _regime_filter(spark, d):
    t = _train(spark, d).join(regime_table(spark, d).select("date", "regime"), "date", "left").withColumn("regime", F.coalesce("regime", F.lit(1)))
    current = t.select("fold").distinct().withColumn("current_regime", F.col("fold") % 3)
    return fo.regime_filter(t, current).select("fold", "date", "ticker", "regime")


@query("wf09_ensemble_score", f"WITH {SQL_SCORES} SELECT date, ticker, {r('(1 - 0.4 * state_prob) * y_proba + 0.4 * state_prob * (1 - y_proba) AS score', '0.6 * y_proba + 0.4 * (1 - y_proba) AS plain')} "
       "FROM scores JOIN regime_tab USING (date)")
def _ensemble(spark, d):
    from tickerloom.catalog.panel_queries import scores

    s = scores(spark, d).join(regime_table(spark, d), "date")
    p = F.col("y_proba")
    return s.select("date", "ticker", mo.ensemble_score(p, 1 - p, F.col("state_prob")).alias("score"), mo.ensemble_score(p, 1 - p).alias("plain"))


@query("wf10_baselines", f"WITH {src.SQL_BARS} SELECT date, ticker, {r('''('0x' || substr(md5('42|' || date || '|' || ticker), 1, 8))::BIGINT / 4294967296.0 AS random''')}, 0.0::DOUBLE AS hold FROM bars")
def _baselines(spark, d):
    b = src.bars(spark, d).select("date", "ticker")
    return mo.hold_baseline(mo.random_baseline(b).withColumnRenamed("y_proba", "random")).withColumnRenamed("y_proba", "hold")


@query("wf11_predict_binary", f"WITH {SQL_SCORES} SELECT date, ticker, CAST(y_proba >= 0.5 AS INTEGER) AS y_pred FROM scores")
def _binary(spark, d):
    from tickerloom.catalog.panel_queries import scores

    return scores(spark, d).select("date", "ticker", mo.predict_binary("y_proba").alias("y_pred"))


# metrics --------------------------------------------------------------------------------------------------------
SQL_PRED = """
pred AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS date, CAST(year(l_shipdate) - 1995 AS INTEGER) AS fold, m.model AS model,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, CAST(year(l_shipdate) % 3 AS INTEGER) AS regime, CASE m.model WHEN 'base' THEN least(l_discount * 10, 1) WHEN 'static' THEN
         l_tax / 0.08 ELSE 0.5 * least(l_discount * 10, 1) + 0.5 * (CAST(l_extendedprice * 100 AS BIGINT) % 1000) / 1000.0 END AS y_proba
  FROM lineitem, (SELECT unnest(['base', 'static', 'ensemble']) AS model) m),
predictions AS (SELECT *, CASE WHEN y_proba >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM pred)"""


def predictions(spark, d):
    """Three scored models per line: two with few distinct scores, one with many."""
    p1 = F.least(F.col("l_discount") * 10, F.lit(1.0))
    p2 = F.col("l_tax") / 0.08
    p3 = F.lit(0.5) * p1 + F.lit(0.5) * F.pmod(F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.lit(1000)) / 1000
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("p")) for n, p in
                                 (("base", p1), ("static", p2), ("ensemble", p3))]))
    year = F.year("l_shipdate")
    rows = src.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("date"),
        (year - 1995).alias("fold"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"), (year % 3).alias("regime"), models.alias("_m"))
    out = rows.select("*", F.col("_m.model").alias("model"), F.col("_m.p").alias("y_proba")).drop("_m")
    return out.withColumn("y_pred", mo.predict_binary("y_proba"))


def _metric_sql(keys: str, source: str = "predictions") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    using = f"JOIN auc USING ({keys})" if keys else ", auc"
    return f"""
counts AS (SELECT {k}avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_pred = 1) AS pp,
  count(*) FILTER (y_true = 1) AS ap, count(*) AS n_samples, avg(y_true) AS pos_rate,
  avg(-CASE WHEN y_true = 1 THEN ln(greatest(least(y_proba, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(y_proba, 1 - 1e-15), 1e-15)) END) AS log_loss FROM {source} {g}),
ranked AS (SELECT {k}y_true, rank() OVER ({part}ORDER BY y_proba) + (count(*) OVER ({part.replace('BY ', 'BY y_proba, ') if part else 'PARTITION BY y_proba'}) - 1) / 2.0 AS rk FROM {source}),
auc AS (SELECT {k}(sum(rk) FILTER (y_true = 1) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1.0) / 2) / nullif(count(*) FILTER (y_true = 1) * 1.0 * count(*) FILTER (y_true = 0), 0)
        AS auc_roc FROM ranked {g}),
metrics AS (SELECT counts.*, auc_roc, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(ap, 0), 0) AS recall, coalesce(2.0 * tp / nullif(pp + ap, 0), 0) AS f1_score
            FROM counts {using})"""


METRIC_ITEMS = r("accuracy", "precision", "recall", "f1_score", "auc_roc", "log_loss", "pos_rate") + ", n_samples"


@query("me01_classification_metrics", f"WITH {SQL_PRED}, {_metric_sql('model')} SELECT model, {METRIC_ITEMS} FROM metrics")
def _metrics(spark, d):
    return me.classification_metrics(predictions(spark, d), ["model"])


DAILY_SQL = src.SQL_INDEX + ", daily AS (SELECT series_id, date, returns AS strategy_return, CAST(month(date) % 3 AS INTEGER) AS regime FROM index_panel WHERE returns IS NOT NULL)"


def daily(spark, d):
    i = index(spark, d).where(F.col("returns").isNotNull())
    return i.select("series_id", "date", F.col("returns").alias("strategy_return"), (F.month("date") % 3).alias("regime"))


def _portfolio_sql(key: str, source: str) -> str:
    return f"""
curve AS (SELECT *, product(1 + strategy_return) OVER (PARTITION BY {key} ORDER BY date) AS equity FROM {source}),
peaks AS (SELECT *, max(equity) OVER (PARTITION BY {key} ORDER BY date) AS peak FROM curve),
tail AS (SELECT {key}, avg(strategy_return) AS cvar_95 FROM (SELECT {key}, strategy_return, row_number() OVER (PARTITION BY {key} ORDER BY strategy_return) AS rn, count(*) OVER (PARTITION BY {key}) AS n
         FROM {source}) WHERE rn <= greatest(1, floor(n * 0.05)) GROUP BY {key}),
base AS (SELECT {key}, avg(strategy_return) * 252 AS ann_return, stddev_samp(strategy_return) * sqrt(252) AS ann_vol, min(equity / peak - 1) AS max_drawdown,
         avg(CASE WHEN strategy_return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, arg_max(equity, date) - 1 AS total_return FROM peaks GROUP BY {key}),
figures AS (SELECT *, coalesce(ann_return / nullif(ann_vol, 0), 0) AS sharpe, coalesce(ann_return / nullif(abs(max_drawdown), 0), 0) AS calmar FROM base JOIN tail USING ({key}))"""


FIGURES = r("ann_return", "ann_vol", "sharpe", "max_drawdown", "calmar", "cvar_95", "hit_rate", "total_return")


@query("me02_portfolio_metrics", f"WITH {DAILY_SQL}, {_portfolio_sql('series_id', 'daily')} SELECT series_id, {FIGURES} FROM figures")
def _portfolio(spark, d):
    return me.portfolio_metrics(daily(spark, d), ["series_id"])


@query("me03_regime_stratified_metrics", f"WITH {DAILY_SQL}, grouped AS (SELECT date, strategy_return, regime::VARCHAR AS regime_group FROM daily WHERE series_id = 'I0' UNION ALL "
       f"SELECT date, strategy_return, 'overall' FROM daily WHERE series_id = 'I0'), {_portfolio_sql('regime_group', 'grouped')} SELECT regime_group, {FIGURES} FROM figures")
def _stratified(spark, d):
    return me.regime_stratified_metrics(daily(spark, d).where("series_id = 'I0'"))


@query("so04_overall_group", f"WITH {DAILY_SQL} SELECT coalesce(regime::VARCHAR, 'overall') AS regime_group, count(*) AS n FROM daily GROUP BY GROUPING SETS ((regime), ())")
def _overall(spark, d):
    groups = F.explode(F.array(F.col("regime").cast("string"), F.lit("overall")))
    return cl.count_values(daily(spark, d).select(groups.alias("regime_group")), "regime_group")


@query("me04_regression_metrics", "SELECT l_returnflag, " + r("avg(pow(l_quantity - l_extendedprice / 1500, 2)) AS mse", "avg(abs(l_quantity - l_extendedprice / 1500)) AS mae",
       "1 - sum(pow(l_quantity - l_extendedprice / 1500, 2)) / (count(*) * var_pop(l_quantity)) AS r2") + " FROM lineitem GROUP BY l_returnflag")
def _regression(spark, d):
    rows = src.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y_true"), (F.col("l_extendedprice") / 1500).alias("y_pred"))
    return me.regression_metrics(rows, ["l_returnflag"])


SQL_PR = """
pc AS (SELECT model, y_proba AS threshold, count(*) FILTER (y_true = 1) AS pos, count(*) AS n FROM predictions GROUP BY ALL),
ps AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS pp, sum(pos) OVER (PARTITION BY model) AS ap FROM pc WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)),
pr AS (SELECT model, threshold, tp / pp AS precision, tp / ap AS recall, 0 AS closing FROM ps UNION ALL SELECT DISTINCT model, 1.0, 1.0, 0.0, 1 FROM predictions)"""


@query("me05_pr_curve", f"WITH {SQL_PRED}, {SQL_PR} SELECT model, closing, {r('threshold', 'precision', 'recall', '2 * precision * recall / nullif(precision + recall, 0) AS f1_score')} FROM pr")
def _pr(spark, d):
    return me.pr_curve(predictions(spark, d), ["model"])


@query("me06_best_threshold_fbeta", f"WITH {SQL_PRED}, {SQL_PR}, f AS (SELECT *, coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0) AS fbeta FROM pr), "
       f"o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY fbeta DESC, closing, threshold) AS rn FROM f) SELECT model, {r('threshold', 'precision', 'recall', 'fbeta')} FROM o WHERE rn = 1")
def _fbeta(spark, d):
    return me.best_threshold_fbeta(predictions(spark, d), 0.5, ["model"])


@query("me07_best_threshold_min_precision", f"WITH {SQL_PRED}, {SQL_PR}, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY CASE WHEN precision >= 0.33 THEN 0 ELSE 1 END, "
       f"CASE WHEN precision >= 0.33 THEN -recall ELSE -precision END, closing, threshold) AS rn FROM pr) SELECT model, {r('threshold', 'precision', 'recall')} FROM o WHERE rn = 1")
def _min_precision(spark, d):
    return me.best_threshold_min_precision(predictions(spark, d), 0.33, ["model"])


@query("me08_equity_curve", f"WITH {DAILY_SQL}, {_portfolio_sql('series_id', 'daily')} SELECT series_id, date, {r('equity', 'peak', 'equity / peak - 1 AS drawdown')} FROM peaks")
def _equity(spark, d):
    return me.equity_curve(daily(spark, d), ["series_id"]).select("series_id", "date", "equity", "peak", "drawdown")


SQL_FOLD_METRICS = f"{SQL_PRED}, {_metric_sql('fold, model')}"


def fold_metrics(spark, d):
    return rp.fold_metrics(predictions(spark, d))


@query("me09_metric_pivot", f"WITH {SQL_FOLD_METRICS} SELECT fold, " + ", ".join(r(f"max(auc_roc) FILTER (model = '{m}') AS {m}") for m in ("base", "static", "ensemble")) + " FROM metrics GROUP BY fold")
def _pivot(spark, d):
    return me.metric_pivot(fold_metrics(spark, d), ["base", "static", "ensemble"])


@query("ag02_fold_metrics", f"WITH {SQL_FOLD_METRICS} SELECT fold, model, {METRIC_ITEMS} FROM metrics")
def _fold_metrics(spark, d):
    return fold_metrics(spark, d)


NAMES = rp.TABLE_METRICS + ("log_loss",)


@query("ag02_fold_summary", f"WITH {SQL_FOLD_METRICS} SELECT model, " + ", ".join(r(f"avg({n}) AS {n}_mean", f"stddev_samp({n}) AS {n}_std") for n in NAMES) + " FROM metrics GROUP BY model")
def _summary(spark, d):
    return rp.fold_summary(fold_metrics(spark, d))


def _text(n: str) -> str:
    return f"printf('%.4f', avg({n})) || ' ± ' || printf('%.4f', stddev_samp({n})) AS {n}"


@query("ag03_model_table", f"WITH {SQL_FOLD_METRICS} SELECT model, {', '.join(_text(n) for n in rp.TABLE_METRICS)} FROM metrics GROUP BY model")
def _model_table(spark, d):
    return rp.model_table(fold_metrics(spark, d))


@query("ag04_model_comparison", f"WITH {SQL_FOLD_METRICS} SELECT model, CASE model WHEN 'base' THEN 'Boosted trees (base)' WHEN 'static' THEN 'Boosted trees (static)' ELSE 'Ensemble' END AS type, "
       + ", ".join(r(f"avg({n}) AS {n}_mean", f"stddev_samp({n}) AS {n}_std") for n in NAMES) + ", " + ", ".join(_text(n) for n in NAMES) + " FROM metrics GROUP BY model")
def _comparison(spark, d):
    return rp.model_comparison(fold_metrics(spark, d))


@query("ag05_regime_performance", f"WITH {SQL_PRED}, named AS (SELECT *, CASE regime WHEN 0 THEN 'Bull' WHEN 1 THEN 'Sideways' ELSE 'Bear' END AS regime_name FROM predictions WHERE model = 'ensemble'), "
       f"{_metric_sql('regime_name', 'named')} SELECT regime_name, {METRIC_ITEMS} FROM metrics")
def _regime_performance(spark, d):
    return rp.regime_performance(predictions(spark, d))


@query("ag10_pooled_metrics", f"WITH {SQL_PRED}, {_metric_sql('model')} SELECT model, {METRIC_ITEMS} FROM metrics")
def _pooled(spark, d):
    return rp.pooled_metrics(predictions(spark, d))


# statistics -----------------------------------------------------------------------------------------------------
P1, P2, Y = "least(l_discount * 10, 1)", "l_tax / 0.08", "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END"


def pair(spark, d):
    return src.table(spark, d, "lineitem").select(
        (F.year("l_shipdate") - 1995).alias("fold"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y_true"),
        F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("p1"), (F.col("l_tax") / 0.08).alias("p2"))


def _dm_sql(e: str) -> str:
    e1, e2 = e.format(p=P1, y=Y), e.format(p=P2, y=Y)
    return (f"WITH l AS (SELECT year(l_shipdate) - 1995 AS fold, {e1} AS e1, {e2} AS e2 FROM lineitem), a AS (SELECT CAST(fold AS INTEGER) AS fold, avg(e1 - e2) / sqrt(nullif(var_samp(e1 - e2) / count(*), 0)) AS z, "
            f"avg(e1) AS mean_loss1, avg(e2) AS mean_loss2 FROM l GROUP BY fold) SELECT fold, {r('z AS dm_statistic', SQL_CDF + ' AS p_value', 'mean_loss1', 'mean_loss2')}")


CLIP = "greatest(least({p}, 1 - 1e-15), 1e-15)"


@query("st01_diebold_mariano", _dm_sql("pow({y} - {p}, 2)") + ", 'brier' AS loss_used FROM a")
def _dm(spark, d):
    return st.diebold_mariano(pair(spark, d), keys=["fold"])


@query("st01_diebold_mariano_logloss", _dm_sql(f"-({{y}} * ln({CLIP}) + (1 - {{y}}) * ln(1 - {CLIP}))") + ", 'logloss' AS loss_used FROM a")
def _dm_log(spark, d):
    return st.diebold_mariano(pair(spark, d), "logloss", keys=["fold"])


SQL_RETURN_PAIR = src.SQL_INDEX + ", rp AS (SELECT a.date, a.returns AS r1, b.returns AS r2 FROM index_panel a JOIN index_panel b ON a.date = b.date AND a.series_id = 'I0' AND b.series_id = 'I1' WHERE a.returns IS NOT NULL AND b.returns IS NOT NULL)"


def return_pair(spark, d):
    i = index(spark, d).where(F.col("returns").isNotNull())
    side = lambda s, n: i.where(F.col("series_id") == s).select("date", F.col("returns").alias(n))
    return side("I0", "r1").join(side("I1", "r2"), "date")


@query("st02_diebold_mariano_returns", f"WITH {SQL_RETURN_PAIR}, l AS (SELECT *, r1 - r2 AS d, lag(r1 - r2, 1) OVER (ORDER BY date) AS d1, lag(r1 - r2, 2) OVER (ORDER BY date) AS d2 FROM rp), "
       "a AS (SELECT avg(d) / sqrt((var_samp(d) + 2 * (covar_samp(d, d1) + covar_samp(d, d2))) / count(*)) AS z, avg(r1) AS mean_return1, avg(r2) AS mean_return2, "
       f"(avg(r1) / stddev_pop(r1) - avg(r2) / stddev_pop(r2)) * sqrt(252) AS sharpe_diff FROM l) SELECT {r('z AS dm_statistic', f'1 - {SQL_CDF} AS p_value', 'mean_return1', 'mean_return2', 'sharpe_diff')} FROM a")
def _dm_returns(spark, d):
    return st.diebold_mariano_returns(return_pair(spark, d), h=3)


REPLICATES = 10_000
_U = "('0x' || substr(md5('42|' || rep || '|' || series_id || '|' || date), 1, 8))::BIGINT / 4294967296.0"
SQL_POISSON = "CASE " + " ".join(f"WHEN u < {edge!r} THEN {k}" for k, edge in enumerate(poisson_one_cdf())) + " ELSE 13 END"


def _boot_sql(stat: str, point: str, replicates: int = REPLICATES) -> str:
    return (f"WITH {DAILY_SQL}, drawn AS (SELECT rep, strategy_return AS x, {_U} AS u FROM daily, range(0, {replicates}) t(rep)), w AS (SELECT rep, x, {SQL_POISSON} AS w FROM drawn), "
            f"s AS (SELECT {stat} AS s FROM w GROUP BY rep) SELECT {r(f'(SELECT {point} FROM daily) AS point_estimate', 'quantile_cont(s, 0.025) AS ci_lower', 'quantile_cont(s, 0.975) AS ci_upper', 'stddev_pop(s) AS std_error')} FROM s")


@query("st03_bootstrap_ci", _boot_sql("sum(w * x) / sum(w)", "avg(strategy_return)"))
def _bootstrap(spark, d):
    return st.bootstrap_ci(daily(spark, d), "strategy_return", ["series_id", "date"], n_bootstrap=REPLICATES)


@query("st04_sharpe_bootstrap_ci", _boot_sql("sum(w * x) / sum(w) / sqrt(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2)) * sqrt(252)",
                                             "avg(strategy_return) / stddev_pop(strategy_return) * sqrt(252)"))
def _sharpe_boot(spark, d):
    return st.sharpe_bootstrap_ci(daily(spark, d), key=("series_id", "date"), n_bootstrap=REPLICATES)


@query("ud01_user_statistic_bootstrap", _boot_sql("max(CASE WHEN w > 0 THEN x END) - min(CASE WHEN w > 0 THEN x END)", "max(strategy_return) - min(strategy_return)", REPLICATES))
def _user_statistic(spark, d):
    return st.bootstrap_ci_callable(daily(spark, d), "strategy_return", ["series_id", "date"], lambda a: float(a.max() - a.min()), REPLICATES)


def _psi_sql(names, source, train, test) -> str:
    tall = " UNION ALL ".join(f"SELECT '{n}' AS feature, round({n}::DOUBLE, 6) AS v, {train} AS is_ref, {test} AS is_cur FROM {source}" for n in names)
    return f"""tall AS ({tall}), ref AS (SELECT * FROM tall WHERE is_ref AND v IS NOT NULL), cur AS (SELECT * FROM tall WHERE is_cur AND v IS NOT NULL),
edges AS (SELECT feature, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN 1.0 ELSE max(v) - min(v) END / 10 AS w FROM ref GROUP BY feature),
rb AS (SELECT feature, CAST(least(greatest(floor((v - lo) / w), 0), 9) AS INTEGER) AS bin, count(*) AS n FROM ref JOIN edges USING (feature) GROUP BY ALL),
cb AS (SELECT feature, CAST(least(greatest(floor((v - lo) / w), 0), 9) AS INTEGER) AS bin, count(*) AS n FROM cur JOIN edges USING (feature) GROUP BY ALL),
spine AS (SELECT feature, CAST(i AS INTEGER) AS bin FROM edges, range(0, 10) t(i)),
share AS (SELECT feature, coalesce(rb.n, 0) / (SELECT count(*) FROM ref WHERE ref.feature = spine.feature) + 1e-6 AS pr, coalesce(cb.n, 0) / (SELECT count(*) FROM cur WHERE cur.feature = spine.feature) + 1e-6 AS pc
          FROM spine LEFT JOIN rb USING (feature, bin) LEFT JOIN cb USING (feature, bin)),
psi AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM share GROUP BY feature)"""


@query("st05_population_stability_index", f"WITH {_psi_sql(['l_extendedprice'], 'lineitem', 'year(l_shipdate) < 1998', 'year(l_shipdate) >= 1998')} SELECT {r('psi')} FROM psi")
def _psi(spark, d):
    rows, year = src.table(spark, d, "lineitem"), F.year("l_shipdate")
    return st.population_stability_index(rows.where(year < 1998), rows.where(year >= 1998), "l_extendedprice")


PSI_NAMES = list(SQL_FEATURES)  # every feature of the matrix


@query("st06_feature_psi", f"{FULL_MATRIX_SQL}, {_psi_sql(PSI_NAMES, 'matrix', 'year(date) < 1999', 'year(date) >= 1999')} SELECT feature, {r('psi')}, psi >= 0.25 AS drifted FROM psi")
def _feature_psi(spark, d):
    # Read three times below, so it is stored once first, as a study does, and goes when the few rows of the result are there.
    folder = new_folder(spark, "matrix")
    m = stored_rounded(matrix(spark, d).select("date", *PSI_NAMES), PSI_NAMES, folder)
    found = stored(st.feature_psi(m.where(F.year("date") < 1999), m.where(F.year("date") >= 1999), PSI_NAMES).coalesce(1))
    removed(spark, folder)
    return found


KS_P = ("CASE WHEN lam < 0.05 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda k: 2.0 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam))), 0.0), 1.0) END")


@query("st07_ks_two_sample", f"WITH {SQL_RETURN_PAIR}, x AS (SELECT r1 AS v, 1 AS a FROM rp UNION ALL SELECT r2, 0 FROM rp), c AS (SELECT v, sum(a) OVER (ORDER BY v) AS ca, sum(1 - a) OVER (ORDER BY v) AS cb, "
       f"sum(a) OVER () AS m, sum(1 - a) OVER () AS n FROM x WHERE v IS NOT NULL), k AS (SELECT max(abs(ca / m - cb / n)) AS ks_statistic, max(m)::DOUBLE AS m, max(n)::DOUBLE AS n FROM c), "
       f"l AS (SELECT ks_statistic, sqrt(m * n / (m + n)) * ks_statistic AS lam FROM k) SELECT {r('ks_statistic', KS_P + ' AS p_value')} FROM l")
def _ks(spark, d):
    p = return_pair(spark, d)
    left, right = p.select(F.col("r1").alias("v")), p.select(F.col("r2").alias("v"))
    return st.ks_two_sample(left, right, "v")


@query("st08_significance_table", f"WITH l AS (SELECT pow({Y} - {P1}, 2) AS e1, pow({Y} - {P2}, 2) AS e2 FROM lineitem), a AS (SELECT avg(e1 - e2) / sqrt(var_samp(e1 - e2) / count(*)) AS z FROM l), "
       f"boot AS ({_boot_sql('sum(w * x) / sum(w)', 'avg(strategy_return)')}) SELECT 'DM: base vs static' AS test, {r('z AS statistic', SQL_CDF + ' AS p_value', 'NULL AS ci_lower', 'NULL AS ci_upper')}, {SQL_CDF} < 0.05 AS significant FROM a "
       f"UNION ALL SELECT 'Bootstrap 95% CI: mean return', {r('point_estimate AS statistic', 'NULL AS p_value', 'ci_lower', 'ci_upper')}, ci_lower > 0 FROM boot")
def _significance(spark, d):
    boot = st.bootstrap_ci(daily(spark, d), "strategy_return", ["series_id", "date"], n_bootstrap=REPLICATES)
    return st.significance_table({"base vs static": st.diebold_mariano(pair(spark, d))}, {"mean return": boot})


@query("tk05_psi_ranked", f"{FULL_MATRIX_SQL}, {_psi_sql(PSI_NAMES, 'matrix', 'year(date) < 1999', 'year(date) >= 1999')} SELECT feature, {r('psi')}, row_number() OVER (ORDER BY round(psi, 6) DESC, feature) AS place FROM psi")
def _psi_ranked(spark, d):
    from pyspark.sql import Window

    # As many rows as features.
    return _feature_psi(spark, d).select("feature", "psi", F.row_number().over(Window.orderBy(F.round("psi", 6).desc(), "feature")).cast("bigint").alias("place"))
