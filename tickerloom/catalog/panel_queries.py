"""Sources, sinks, cleaning, joins, aggregates, rankings and set operations."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tickerloom.catalog import inputs as src
from tickerloom.catalog.feature_queries import index_panel, panel
from tickerloom.catalog.registry import query, r
from tickerloom.config import FoldSettings
from tickerloom.functions.columns import hash_uniform, normal_cdf
from tickerloom.functions.scan import most_frequent
from tickerloom.operators import alignment as al, cleaning as cl, folds as fo, portfolio as pf, quality as qa
from tickerloom.session import new_folder, stored
from tickerloom.sources import tables as io

BAR_ITEMS = r("open", "high", "low", "close", "volume")


def scratch(spark) -> str:
    """A new folder for a query that writes and reads back, shared by all executors."""
    return new_folder(spark)


# sources and sinks ----------------------------------------------------------------------------------------------
@query("io01_scan_bars", f"WITH {src.SQL_BARS} SELECT ticker, date, {BAR_ITEMS} FROM bars")
def _scan_bars(spark, d):
    path = f"{scratch(spark)}/bars"
    src.bars(spark, d).write.parquet(path)
    return io.scan_bars(spark, path).select("ticker", "date", "open", "high", "low", "close", "volume")


@query("io02_scan_csv", f"SELECT o_orderkey, o_orderstatus, {r('o_totalprice')} FROM orders")
def _scan_csv(spark, d):
    path = f"{scratch(spark)}/orders"
    src.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.option("header", True).csv(path)
    return io.scan_csv(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("io03_standardise_columns", f"WITH {src.SQL_BARS} SELECT 'BTC' AS ticker, date, {r('open', 'high', 'low', 'close')}, "
       "0.0::DOUBLE AS volume FROM bars")
def _standardise(spark, d):
    vendor = src.bars(spark, d).select(F.col("date").alias(" Trading_Date "), F.col("open").alias("OPEN"),
                                       F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("CLOSE"))
    return io.standardise_columns(vendor, "btc_daily").select("ticker", "date", "open", "high", "low", "close", "volume")


@query("io04_union_universe", f"WITH {src.SQL_BARS} SELECT ticker, date, {r('close')} FROM bars")
def _union(spark, d):
    base, bars = scratch(spark), src.bars(spark, d)
    last = F.substring("ticker", -1, 1).cast("int")
    paths = []
    for part in range(2):
        paths.append(f"{base}/part{part}")
        bars.where(last % 2 == part).write.parquet(paths[-1])
    return io.union_universe(spark, paths).select("ticker", "date", "close")


@query("io05_sink_parquet", f"WITH {src.SQL_BARS} SELECT ticker, date, {r('close')}, year(date)::INTEGER AS year FROM bars")
def _sink(spark, d):
    path = f"{scratch(spark)}/bars"
    io.sink_parquet(src.bars(spark, d), path)
    return spark.read.parquet(path).select("ticker", "date", "close", "year")


@query("io05_feature_cache", f"WITH {src.SQL_PANEL} SELECT ticker, date, {r('returns')} FROM panel")
def _cache(spark, d):
    base, bars = scratch(spark), stored(src.bars(spark, d))  # each call reads all rows for their mark, and the first builds from them
    for _ in range(2):  # the second call finds the stored table
        out = io.cached_features(spark, bars, FoldSettings(), cl.derive_bar_columns, base)
    return out.select("ticker", "date", "returns")


@query("io06_sink_csv", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _sink_csv(spark, d):
    path = f"{scratch(spark)}/table"
    io.sink_csv(cl.count_values(src.table(spark, d, "lineitem"), "l_returnflag"), path)
    return io.scan_csv(spark, path).select("l_returnflag", F.col("n").cast("bigint").alias("n"))


@query("io07_content_registry", "WITH h AS (SELECT doc_id, sha256(text) AS sha256, strlen(text)::INTEGER AS size_bytes FROM documents) "
       "SELECT doc_id, sha256, size_bytes, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256) THEN 'created' "
       "ELSE 'deduplicated' END AS status FROM h")
def _registry(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "text")
    return io.content_registry(docs, "text", ("doc_id",)).select("doc_id", "sha256", "size_bytes", "status")


@query("io08_source_lines", "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) "
       "SELECT doc_id, unnest(range(1, len(parts) + 1))::INTEGER AS line_no, unnest(parts) AS line FROM s")
def _lines(spark, d):
    return io.number_lines(src.table(spark, d, "documents"), "text", ("doc_id",))


SQL_FILES = ("files AS (SELECT 'report_' || page_id || CASE page_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.csv' WHEN 2 THEN '.pdf' "
             "WHEN 3 THEN '.txt' WHEN 4 THEN '.tex' ELSE '.html' END AS name, strlen(html)::INTEGER AS size_bytes FROM pages)")
SQL_LISTING = SQL_FILES + (", listing AS (SELECT *, CASE lower(split_part(name, '.', 2)) WHEN 'png' THEN 'image/png' WHEN 'csv' THEN "
                           "'text/csv' WHEN 'pdf' THEN 'application/pdf' ELSE 'text/plain' END AS content_type, "
                           "CASE lower(split_part(name, '.', 2)) WHEN 'png' THEN 'plot' WHEN 'csv' THEN 'dataset' WHEN 'pdf' THEN "
                           "'report' WHEN 'tex' THEN 'report' ELSE 'other' END AS artifact_type FROM files WHERE name NOT LIKE '%.html')")


def listing(spark, d):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".PNG", ".csv", ".pdf", ".txt", ".tex", ".html")]),
                          (F.col("page_id") % 6 + 1).cast("int"))
    files = src.table(spark, d, "pages").select(
        F.concat(F.lit("report_"), F.col("page_id").cast("string"), suffix).alias("name"), F.octet_length("html").alias("size_bytes"))
    return io.classify_artifacts(files)


@query("io09_classify_artifact", f"WITH {SQL_LISTING} SELECT * FROM listing")
def _artifacts(spark, d):
    return listing(spark, d)


# cleaning -------------------------------------------------------------------------------------------------------
SQL_DEDUPED = src.SQL_BARS_DIRTY + """,
deduped AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY date, ticker ORDER BY ord DESC) AS rn
            FROM bars_dirty) WHERE rn = 1),
complete AS (SELECT * FROM deduped WHERE close IS NOT NULL AND volume IS NOT NULL),
clean AS (SELECT * FROM complete WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0)"""
SQL_PROCESSED = SQL_DEDUPED + """,
referenced AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS ref_price FROM clean),
processed AS (
  SELECT *, close / ref_price - 1 AS returns, ln(1 + (close / ref_price - 1)) AS log_returns,
         CASE WHEN (close - ref_price) / ref_price >= 0.068 THEN 1 ELSE 0 END AS is_limit_up,
         CASE WHEN (close - ref_price) / ref_price <= -0.068 THEN 1 ELSE 0 END AS is_limit_down,
         CASE WHEN volume = 0 THEN 1 ELSE 0 END AS is_suspended FROM referenced)"""


@query("pr01_dedupe_keep_last", f"WITH {SQL_DEDUPED} SELECT ticker, date, ord, {BAR_ITEMS} FROM deduped")
def _dedupe(spark, d):
    return cl.dedupe_keep_last(src.bars_dirty(spark, d), ["date", "ticker"], ["ord"])


@query("pr02_drop_null_ohlcv", f"WITH {SQL_DEDUPED} SELECT ticker, date, ord, {BAR_ITEMS} FROM complete")
def _drop_null(spark, d):
    return cl.drop_null_ohlcv(cl.dedupe_keep_last(src.bars_dirty(spark, d), ["date", "ticker"], ["ord"]))


@query("pr03_filter_valid_prices", f"WITH {SQL_DEDUPED} SELECT ticker, date, {BAR_ITEMS} FROM clean")
def _valid(spark, d):
    return cl.clean_bars(src.bars_dirty(spark, d), ["ord"])


@query("pr04_cast_bars", f"WITH {src.SQL_BARS} SELECT ticker, date, {r('open', 'high', 'low')}, "
       f"{r('CASE WHEN day(date) % 4 <> 0 THEN close END AS close', 'volume')} FROM bars")
def _cast(spark, d):
    text = src.bars(spark, d).select(*[F.col(c).cast("string").alias(c) for c in ("date", "ticker", "open", "high", "low", "close", "volume")])
    broken = F.when(F.dayofmonth(F.to_date("date")) % 4 == 0, "n/a").otherwise(F.col("close"))
    return cl.cast_bars(text.withColumn("close", broken))


@query("pr05_add_returns", f"WITH {src.SQL_PANEL} SELECT ticker, date, {r('returns', 'log_returns')} FROM panel")
def _returns(spark, d):
    return cl.add_returns(src.bars(spark, d)).select("ticker", "date", "returns", "log_returns")


@query("pr06_add_reference_price", f"WITH {src.SQL_PANEL} SELECT ticker, date, {r('ref_price')} FROM panel")
def _reference(spark, d):
    return cl.add_reference_price(src.bars(spark, d)).select("ticker", "date", "ref_price")


@query("pr07_flag_price_limits", f"WITH {src.SQL_PANEL} SELECT ticker, date, is_limit_up, is_limit_down FROM panel")
def _limits(spark, d):
    return cl.flag_price_limits(src.bars(spark, d)).select("ticker", "date", "is_limit_up", "is_limit_down")


@query("pr08_flag_suspended", f"WITH {SQL_PROCESSED} SELECT ticker, date, is_suspended FROM processed")
def _suspended(spark, d):
    return cl.flag_suspended(cl.clean_bars(src.bars_dirty(spark, d), ["ord"])).select("ticker", "date", "is_suspended")


@query("pr09_process_bars", f"WITH {SQL_PROCESSED} SELECT ticker, date, {BAR_ITEMS}, {r('ref_price', 'returns', 'log_returns')}, "
       "is_limit_up, is_limit_down, is_suspended FROM processed")
def _process(spark, d):
    return cl.process_bars(src.bars_dirty(spark, d), order=["ord"])


@query("pr09_process_index", f"WITH {src.SQL_INDEX} SELECT series_id, date, {r('close', 'returns')}, "
       f"{r('ln(1 + returns) AS log_returns')} FROM index_panel")
def _process_index(spark, d):
    return cl.process_index(src.index_bars(spark, d)).select("series_id", "date", "close", "returns", "log_returns")


@query("pr09_bar_counts", f"WITH {SQL_PROCESSED} SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, count(DISTINCT date) "
       "AS n_dates, sum(is_limit_up)::BIGINT AS n_limit_up, sum(is_limit_down)::BIGINT AS n_limit_down, "
       "sum(is_suspended)::BIGINT AS n_suspended FROM processed")
def _counts(spark, d):
    return cl.bar_counts(cl.process_bars(src.bars_dirty(spark, d), order=["ord"]))


@query("pr10_feature_columns", f"WITH {src.SQL_PANEL} SELECT 'rsi_14' AS feature, count(*) AS n_rows FROM panel")
def _feature_columns(spark, d):
    from tickerloom.operators.features import build, rsi

    df = build(panel(spark, d), [rsi()])
    return df.agg(F.lit(",".join(cl.feature_columns(df))).alias("feature"), F.count(F.lit(1)).alias("n_rows"))


@query("pr11_downcast_float", f"WITH {src.SQL_PANEL} SELECT ticker, date, close::FLOAT AS close, returns::FLOAT AS returns FROM panel")
def _downcast(spark, d):
    return cl.downcast_float(panel(spark, d).select("ticker", "date", "close", "returns"))


@query("pr12_inf_to_null", f"WITH {src.SQL_BARS} SELECT ticker, date, {r('CASE WHEN volume > 10 THEN close END AS x')}, "
       f"{r('CASE WHEN volume > 10 THEN close ELSE 0 END AS y')} FROM bars")
def _inf(spark, d):
    odd = F.when(F.col("volume") > 10, F.col("close")).when(F.col("volume") > 5, float("inf")).otherwise(float("nan"))
    df = src.bars(spark, d).select("ticker", "date", odd.alias("x"))
    df = cl.inf_to_null(df, ["x"])
    return cl.nan_to_zero(df.withColumn("y", F.col("x")), ["y"])


@query("pr13_date_range_split", f"WITH {src.SQL_BARS} SELECT ticker, date, {r('close')} FROM bars WHERE date BETWEEN '1997-01-15' AND '1998-06-30'")
def _range(spark, d):
    return cl.date_range_split(src.bars(spark, d).select("ticker", "date", "close"), "1997-01-15", "1998-06-30")


@query("pr14_recent_window", f"WITH {src.SQL_BARS} SELECT ticker, date, {r('close')} FROM bars "
       "WHERE date >= (SELECT max(date) - INTERVAL 24 MONTH FROM bars)")
def _recent(spark, d):
    return cl.recent_window(src.bars(spark, d).select("ticker", "date", "close"), 2)


# scalar families ------------------------------------------------------------------------------------------------
@query("sc01_math", f"WITH {src.SQL_PANEL} SELECT ticker, date, {r('ln(close) AS a', 'ln(1 + returns) AS b', 'sqrt(volume) AS c', 'sign(returns) AS d', 'abs(returns) AS e', 'pow(0.997, volume) AS f', 'greatest(returns, 0) AS g')} FROM panel WHERE returns IS NOT NULL")
def _math(spark, d):
    x = F.col("returns")
    return panel(spark, d).where(x.isNotNull()).select(
        "ticker", "date", F.ln("close").alias("a"), F.log1p(x).alias("b"), F.sqrt("volume").alias("c"), F.signum(x).alias("d"),
        F.abs(x).alias("e"), F.pow(F.lit(0.997), F.col("volume")).alias("f"), F.greatest(x, F.lit(0.0)).alias("g"))


_T = "(1 / (1 + 0.3275911 * abs(z) / sqrt(2)))"
SQL_ERF = (f"(1 - ((((1.061405429 * {_T} - 1.453152027) * {_T} + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T} "
           "* exp(-z * z / 2))")
SQL_CDF = f"0.5 * (1 + sign(z) * {SQL_ERF})"


@query("sc02_normal_cdf", f"WITH {src.SQL_PANEL}, v AS (SELECT ticker, date, returns * 20 AS z FROM panel WHERE returns IS NOT NULL) "
       f"SELECT ticker, date, {r(SQL_CDF + ' AS cdf')} FROM v")
def _cdf(spark, d):
    return panel(spark, d).where(F.col("returns").isNotNull()).select("ticker", "date", normal_cdf(F.col("returns") * 20).alias("cdf"))


@query("sc03_dates", "SELECT o_orderkey, (CAST(o_orderdate AS DATE) + INTERVAL 5 MONTH)::DATE AS plus_months, CAST(o_orderdate AS DATE) + 7 "
       "AS plus_days, strftime(o_orderdate, '%Y-%m-%d') AS as_text FROM orders")
def _dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    return src.table(spark, d, "orders").select("o_orderkey", F.add_months(day, 5).alias("plus_months"),
                                                F.date_add(day, 7).alias("plus_days"),
                                                F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_text"))


@query("sc04_strings", "SELECT page_id, lower(trim(url)) AS u, contains(url, 'ref=') AS has_ref, "
       "len(string_split(url, '/'))::INTEGER AS parts, regexp_extract(url, '([a-z]+)[.]example', 1) AS host FROM pages")
def _strings(spark, d):
    url = F.col("url")
    return src.table(spark, d, "pages").select("page_id", F.lower(F.trim(url)).alias("u"), url.contains("ref=").alias("has_ref"),
                                               F.size(F.split(url, "/")).alias("parts"),
                                               F.regexp_extract(url, "([a-z]+)[.]example", 1).alias("host"))


@query("sc05_sha256", "SELECT item_id, sha256(text) AS h FROM benchmark")
def _sha(spark, d):
    return src.table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))


@query("sc06_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{\"type\":\"' || event_type || '\"}' AS doc FROM events")
def _json(spark, d):
    return src.table(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"),
                                                F.to_json(F.struct(F.col("event_type").alias("type"))).alias("doc"))


@query("sc09_bucketing", f"WITH {src.SQL_BARS} SELECT ticker, date, CAST(least(greatest(floor((close - 101) / 0.8), 0), 9) AS INTEGER) AS bin FROM bars")
def _buckets(spark, d):
    slot = F.floor((F.col("close") - 101) / 0.8)
    return src.bars(spark, d).select("ticker", "date", F.least(F.greatest(slot, F.lit(0)), F.lit(9)).cast("int").alias("bin"))


# joins ----------------------------------------------------------------------------------------------------------
SQL_SCORES = src.SQL_PANEL + """,
scores AS (SELECT date, ticker, ('0x' || substr(md5(ticker || '|' || date), 1, 8))::BIGINT / 4294967296.0 AS y_proba
           FROM bars),
regime_tab AS (SELECT DISTINCT date, CAST(day(date) % 3 AS INTEGER) AS regime,
                      ('0x' || substr(md5(date::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS state_prob
               FROM bars WHERE dayofyear(date) % 5 <> 0),
changes AS (SELECT ticker, date, CASE WHEN h < 500000000 THEN 'added' ELSE 'removed' END AS action
            FROM (SELECT ticker, date, ('0x' || substr(md5('m' || ticker || '|' || date), 1, 8))::BIGINT AS h FROM bars) WHERE h < 1000000000 AND day(date) = 15),
current_list AS (SELECT DISTINCT ticker FROM bars WHERE CAST(right(ticker, 1) AS INTEGER) < 7)"""


def scores(spark, d):
    b = src.bars(spark, d)
    return b.select("date", "ticker", hash_uniform("ticker", "date").alias("y_proba"))


def regime_table(spark, d):
    days = src.bars(spark, d).select("date").distinct().where(F.dayofyear("date") % 5 != 0)
    return days.select("date", (F.dayofmonth("date") % 3).cast("int").alias("regime"), hash_uniform("date").alias("state_prob"))


def changes(spark, d):
    h = hash_uniform(F.concat(F.lit("m"), F.col("ticker")), "date") * 4294967296.0
    b = src.bars(spark, d).where((h < 1000000000) & (F.dayofmonth("date") == 15))
    return b.select("ticker", "date", F.when(h < 500000000, "added").otherwise("removed").alias("action"))


def current_list(spark, d):
    return src.bars(spark, d).where(F.substring("ticker", -1, 1).cast("int") < 7).select("ticker").distinct()


@query("jn01_align_index_returns", f"WITH {src.SQL_INDEX} SELECT ticker, date, {r('returns AS index_returns')} FROM bars LEFT JOIN "
       "whole_index USING (date)")
def _align(spark, d):
    return al.align_index_returns(src.bars(spark, d), index_panel(spark, d)).select("ticker", "date", "index_returns")


@query("jn02_merge_regime_sources", f"WITH {src.SQL_INDEX} SELECT series_id, date, {r('a', 'b', 'c')} FROM (SELECT series_id, date, close AS a "
       "FROM index_bars WHERE day(date) % 2 = 0) FULL JOIN (SELECT series_id, date, high AS b FROM index_bars WHERE day(date) % 3 = 0) "
       "USING (series_id, date) FULL JOIN (SELECT series_id, date, low AS c FROM index_bars WHERE day(date) % 5 = 0) USING (series_id, date)")
def _merge(spark, d):
    i, dom = src.index_bars(spark, d), F.dayofmonth("date")
    pick = lambda m, c, n: i.where(dom % m == 0).select("series_id", "date", F.col(c).alias(n))
    return al.merge_regime_sources(pick(2, "close", "a"), pick(3, "high", "b"), pick(5, "low", "c"))


SQL_ASKED = "asked AS (SELECT DISTINCT date FROM bars WHERE day(date) % 2 = 0)"


@query("jn03_regime_for_dates", f"WITH {SQL_SCORES}, {SQL_ASKED} SELECT date, coalesce(last_value(regime IGNORE NULLS) OVER (ORDER BY date ROWS "
       "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS regime FROM asked LEFT JOIN regime_tab USING (date)")
def _regime_dates(spark, d):
    return al.regime_for_dates(regime_table(spark, d), src.bars(spark, d).where(F.dayofmonth("date") % 2 == 0))


@query("jn03_regime_asof", f"WITH {SQL_SCORES}, {SQL_ASKED} SELECT date, coalesce((SELECT max_by(regime, t.date) FROM regime_tab t WHERE "
       "t.date <= asked.date), 1) AS regime FROM asked")
def _regime_asof(spark, d):
    return al.regime_for_dates(regime_table(spark, d), src.bars(spark, d).where(F.dayofmonth("date") % 2 == 0), asof=True)


@query("jn04_attach_target", f"WITH {src.SQL_PANEL} SELECT ticker, date, {r('returns', 'lead(close, 3) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd_return')} FROM panel")
def _attach(spark, d):
    from tickerloom.operators.features import with_target

    return with_target(panel(spark, d)).select("ticker", "date", "returns", "fwd_return")


SQL_SIGNALS = SQL_SCORES + """,
cal AS (SELECT date AS trade_date, lag(date) OVER (ORDER BY date) AS signal_date FROM (SELECT DISTINCT date FROM scores)),
signals AS (SELECT c.trade_date, c.signal_date, s.ticker, s.y_proba, t.close AS close_today, p.close AS close_prev,
                   coalesce(t.is_limit_up, 0) AS up, coalesce(t.is_limit_down, 0) AS down
            FROM cal c JOIN scores s ON s.date = c.signal_date LEFT JOIN panel t ON t.date = c.trade_date AND t.ticker = s.ticker
            LEFT JOIN panel p ON p.date = c.signal_date AND p.ticker = s.ticker)"""


@query("jn05_prices_for_signals", f"WITH {SQL_SIGNALS} SELECT trade_date, signal_date, ticker, {r('y_proba', 'close_today', 'close_prev')} FROM signals")
def _signals(spark, d):
    return al.prices_for_signals(scores(spark, d), panel(spark, d)).select(
        "trade_date", "signal_date", "ticker", "y_proba", "close_today", "close_prev")


SQL_MEMBER = ("coalesce((SELECT arg_min(c.action, c.date) FROM changes c WHERE c.ticker = {t} AND c.date > {d}) = 'removed', "
              "{t} IN (SELECT ticker FROM current_list))")


@query("jn06_point_in_time_members", f"WITH {SQL_SCORES} SELECT ticker, date FROM bars b WHERE " + SQL_MEMBER.format(t="b.ticker", d="b.date"))
def _members(spark, d):
    spans = al.membership_spans(changes(spark, d), current_list(spark, d))
    return al.filter_members(src.bars(spark, d), spans).select("ticker", "date")


@query("jn07_all_historical_members", f"WITH {SQL_SCORES} SELECT ticker FROM current_list UNION SELECT ticker FROM changes WHERE action = 'removed'")
def _historical(spark, d):
    return al.all_historical_members(changes(spark, d), current_list(spark, d))


@query("jn08_universe_mode", f"WITH {SQL_SCORES} SELECT count(*) AS n_rows, (SELECT count(*) > 0 FROM scores JOIN current_list USING (ticker)) AS shared FROM scores")
def _universe(spark, d):
    s = scores(spark, d)
    return s.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("shared", al.shares_universe(s, current_list(spark, d)))


DEFAULT_FOLDS_SQL = """folds AS (
  SELECT CAST(i AS INTEGER) AS fold, lo AS train_start, CAST(lo + to_months(60 + 3 * CAST(i AS INTEGER)) AS DATE) AS train_end,
         CAST(lo + to_months(60 + 3 * CAST(i AS INTEGER)) AS DATE) + 1 AS test_start,
         CAST(least(CAST(CAST(lo + to_months(60 + 3 * CAST(i AS INTEGER)) AS DATE) + 1 + INTERVAL 6 MONTH AS DATE) - 1, hi) AS DATE) AS test_end
  FROM (SELECT min(date) AS lo, max(date) AS hi FROM bars), range(0, 40) t(i)
  WHERE CAST(lo + to_months(60 + 3 * CAST(i AS INTEGER)) AS DATE) + 1 < hi)"""


@query("jn09_regime_confidence", f"WITH {SQL_SCORES}, {DEFAULT_FOLDS_SQL}, asked AS (SELECT DISTINCT fold, date FROM bars JOIN folds ON date BETWEEN "
       f"test_start AND test_end) SELECT fold, {r('coalesce(avg(state_prob), 0.5) AS confidence')} FROM asked LEFT JOIN regime_tab USING (date) GROUP BY fold")
def _confidence(spark, d):
    b = src.bars(spark, d)
    return al.regime_confidence(regime_table(spark, d), al.assign_folds(b, fo.data_folds(b), "test"))


@query("jn10_assign_folds", f"WITH {src.SQL_BARS}, {DEFAULT_FOLDS_SQL} SELECT ticker, date, fold, 'train' AS part FROM bars JOIN folds ON date BETWEEN "
       "train_start AND train_end UNION ALL SELECT ticker, date, fold, 'test' FROM bars JOIN folds ON date BETWEEN test_start AND test_end")
def _assign(spark, d):
    b = src.bars(spark, d)
    return al.assign_folds(b, fo.data_folds(b)).select("ticker", "date", "fold", "part")


@query("jn11_feature_target_align", f"WITH {src.SQL_PANEL}, t AS (SELECT ticker, returns, lead(close, 3) OVER (PARTITION BY ticker ORDER BY date) / "
       f"close - 1 AS fwd_return FROM panel) SELECT count(*) AS n_pairs, {r('corr(returns, fwd_return) AS corr')} FROM t WHERE returns IS NOT NULL AND fwd_return IS NOT NULL")
def _pairs(spark, d):
    from tickerloom.operators.features import with_target
    from tickerloom.operators.statistics import leakage_check

    return leakage_check(with_target(panel(spark, d)), ["returns"]).select("n_pairs", "corr")


# aggregates, rankings, sets -------------------------------------------------------------------------------------
@query("ag01_equal_weight_index", f"WITH {src.SQL_BARS} SELECT date, {r('avg(open) AS open', 'avg(high) AS high', 'avg(low) AS low', 'avg(close) AS close', 'sum(volume) AS volume')} FROM bars GROUP BY date")
def _index(spark, d):
    return pf.equal_weight_index(src.bars(spark, d))


@query("ag06_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _value_counts(spark, d):
    return cl.count_values(src.table(spark, d, "events"), "event_type")


@query("ag07_mode_smallest", "WITH c AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, q AS mode, n "
       "FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, q) AS rn FROM c) WHERE rn = 1")
def _smallest_mode(spark, d):
    rows = src.table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    return most_frequent(rows, ["l_suppkey"], "q", "mode", "n")


@query("ag09_null_and_distinct_counts", f"WITH {src.SQL_BARS_DIRTY}, c AS (SELECT unnest(['ticker', 'close', 'volume']) AS \"column\", count(*) AS total_count, "
       "unnest([count(*) FILTER (ticker IS NULL), count(*) FILTER (close IS NULL), count(*) FILTER (volume IS NULL)]) AS missing_count, "
       "unnest([count(DISTINCT ticker), count(DISTINCT close), count(DISTINCT volume)]) AS unique_count FROM bars_dirty) SELECT * FROM c")
def _null_counts(spark, d):
    return qa.column_counts(src.bars_dirty(spark, d), ["ticker", "close", "volume"])


SQL_AVAILABLE = SQL_SIGNALS + """,
available AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY y_proba, ticker) AS rk,
                     count(*) OVER (PARTITION BY trade_date) AS n FROM signals s WHERE up = 0 AND down = 0)"""


@query("tk01_select_lowest_half", f"WITH {SQL_AVAILABLE} SELECT trade_date, ticker, {r('y_proba')}, rk <= greatest(1, n // 2) AS selected, n AS n_available FROM available")
def _lowest(spark, d):
    signals = al.prices_for_signals(scores(spark, d), panel(spark, d))
    free = signals.where(F.coalesce((F.col("is_limit_up") + F.col("is_limit_down")) == 0, F.lit(True)))
    return pf.select_lowest_half(free).select("trade_date", "ticker", "y_proba", "selected", "n_available")


@query("tk02_worst_tail", f"WITH {src.SQL_INDEX}, q AS (SELECT series_id, returns, row_number() OVER (PARTITION BY series_id ORDER BY returns) AS rk, count(*) "
       f"OVER (PARTITION BY series_id) AS n FROM index_panel WHERE returns IS NOT NULL) SELECT series_id, {r('avg(returns) AS cvar_95')} FROM q "
       "WHERE rk <= greatest(1, floor(n * 0.05)) GROUP BY series_id")
def _tail(spark, d):
    from tickerloom.operators.metrics import worst_tail

    i = cl.process_index(src.index_bars(spark, d)).where(F.col("returns").isNotNull())
    return worst_tail(i, ["series_id"], "returns")


@query("so01_concat_fold_predictions_keep_last", f"WITH {SQL_SCORES}, {DEFAULT_FOLDS_SQL}, p AS (SELECT fold, date, ticker, y_proba + fold AS y_proba FROM scores JOIN folds "
       f"ON date BETWEEN test_start AND test_end) SELECT fold, date, ticker, {r('y_proba')} FROM p WHERE (date, ticker, fold) IN (SELECT (date, ticker, max(fold)) FROM p GROUP BY date, ticker)")
def _keep_last(spark, d):
    s = scores(spark, d)
    p = al.assign_folds(s, fo.data_folds(src.bars(spark, d)), "test").drop("part")
    return pf.keep_latest_fold(p.withColumn("y_proba", F.col("y_proba") + F.col("fold")))


@query("so02_membership_sets", f"WITH {SQL_SCORES} SELECT ticker FROM current_list EXCEPT SELECT ticker FROM changes WHERE action = 'removed'")
def _sets(spark, d):
    return current_list(spark, d).join(changes(spark, d).where("action = 'removed'"), "ticker", "left_anti")


@query("so03_common_tickers", f"WITH {SQL_SCORES} SELECT ticker FROM scores INTERSECT SELECT ticker FROM current_list")
def _common(spark, d):
    return al.common_tickers(scores(spark, d), current_list(spark, d))


@query("tk06_panel_order", f"WITH {src.SQL_BARS} SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars")
def _panel_order(spark, d):
    from tickerloom.catalog.feature_queries import K

    return src.bars(spark, d).select("ticker", "date", K.row_number().cast("bigint").alias("rn")).orderBy("ticker", "date")


@query("wf16_simulate_portfolio", f"WITH {SQL_SIGNALS}, eligible AS (SELECT * FROM signals s WHERE up = 0 AND down = 0 AND " + SQL_MEMBER.format(t="s.ticker", d="s.trade_date")
       + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY y_proba, ticker) AS rk, count(*) OVER (PARTITION BY trade_date) AS n FROM eligible),
moved AS (SELECT *, coalesce(close_today / close_prev - 1, 0) AS move, rk <= greatest(1, n // 2) AS chosen FROM ranked),
daily AS (SELECT trade_date, count(*) FILTER (chosen) AS n_positions, sum(move) FILTER (chosen) AS picked, avg(move) AS bench FROM moved GROUP BY trade_date)
SELECT c.trade_date AS date, """ + r("CASE WHEN n_positions IS NULL THEN 0 ELSE picked / n_positions - 2 / 3.0 * 0.0025 * 2 END AS strategy_return",
                                     "coalesce(bench, 0) AS benchmark_return", "CASE WHEN n_positions IS NULL THEN 0 ELSE 2 / 3.0 END AS turnover")
       + ", coalesce(n_positions, 0) AS n_positions FROM cal c LEFT JOIN daily d ON d.trade_date = c.trade_date WHERE c.signal_date IS NOT NULL")
def _portfolio(spark, d):
    return pf.simulate_portfolio(scores(spark, d), panel(spark, d), changes(spark, d), current_list(spark, d))
