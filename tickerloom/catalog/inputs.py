"""Operator inputs derived from the given tables, once for Spark and once as SQL text.

Tickers are suppliers, so the number of series, bars and scores grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticker(key) -> F.col:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 10, "0"))


def unit_price():
    """Prices in 64ths above 97: sums are exact in any order, and ratios to the lowest price never end at a rounding tie."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.lit(97.0) + F.pmod(cents, F.lit(640)) / F.lit(64.0)


def trades(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), ticker("l_suppkey").alias("ticker"),
        unit_price().alias("px"), F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"))


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return trades(spark, folder).groupBy("date", "ticker").agg(
        F.min_by("px", "o").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "o").alias("close"), F.sum("qty").alias("volume"))


SQL_BARS = """
bars AS (
  SELECT CAST(l_shipdate AS DATE) AS date, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS ticker,
         arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, 97.0::DOUBLE + (CAST(round(l_extendedprice * 100) AS BIGINT) % 640) / 64.0::DOUBLE AS px,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o FROM lineitem)
  GROUP BY ALL)"""


def bars_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with repeated keys, missing, zero and negative values; ``ord`` is the input order."""
    base = bars(spark, folder).withColumn("ord", F.lit(0))
    doy, dom = F.dayofyear("date"), F.dayofmonth("date")
    copies = base.where(doy % 50 == 0).withColumns({"close": F.col("close") + 1, "ord": F.lit(1)})
    lost = base.where(doy % 75 == 0).withColumns({"close": F.lit(None).cast("double"), "ord": F.lit(2)})
    spoiled = base.withColumns({
        "close": F.when(dom == 7, F.lit(0.0)).when(dom == 9, F.lit(None).cast("double")).otherwise(F.col("close")),
        "volume": F.when(dom == 11, F.lit(-1.0)).when(dom == 13, F.lit(0.0)).otherwise(F.col("volume"))})
    return spoiled.unionByName(copies).unionByName(lost)


SQL_BARS_DIRTY = SQL_BARS + """,
bars_dirty AS (
  SELECT date, ticker, open, high, low,
         CASE day(date) WHEN 7 THEN 0.0 WHEN 9 THEN NULL ELSE close END AS close,
         CASE day(date) WHEN 11 THEN -1.0 WHEN 13 THEN 0.0 ELSE volume END AS volume, 0 AS ord FROM bars
  UNION ALL SELECT date, ticker, open, high, low, close + 1, volume, 1 FROM bars WHERE dayofyear(date) % 50 = 0
  UNION ALL SELECT date, ticker, open, high, low, NULL, volume, 2 FROM bars WHERE dayofyear(date) % 75 = 0)"""

SQL_PANEL = SQL_BARS + """,
panel AS (
  SELECT *, close / ref_price - 1 AS returns, ln(close / ref_price) AS log_returns,
         CASE WHEN (close - ref_price) / ref_price >= 0.07 - 0.002 THEN 1 ELSE 0 END AS is_limit_up,
         CASE WHEN (close - ref_price) / ref_price <= -0.07 + 0.002 THEN 1 ELSE 0 END AS is_limit_down,
         CASE WHEN volume = 0 THEN 1 ELSE 0 END AS is_suspended
  FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS ref_price FROM bars))"""


def series_id():
    return F.concat(F.lit("I"), (F.substring("ticker", -1, 1).cast("int") % 2).cast("string"))


def index_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Two equal-weight indices: even and odd tickers."""
    return bars(spark, folder).groupBy(series_id().alias("series_id"), "date").agg(
        *[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))


def whole_index(spark: SparkSession, folder: str, made: DataFrame | None = None) -> DataFrame:
    """One equal-weight index of all tickers. ``made``: the bars, if they are there already."""
    return (bars(spark, folder) if made is None else made).groupBy(F.lit("ALL").alias("series_id"), "date").agg(
        *[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))


SQL_INDEX = SQL_BARS + """,
whole_index AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS returns FROM (SELECT date, avg(close) AS close FROM bars GROUP BY date)),
index_bars AS (
  SELECT 'I' || CAST(CAST(right(ticker, 1) AS INTEGER) % 2 AS VARCHAR) AS series_id, date, avg(open) AS open,
         avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY ALL),
index_panel AS (
  SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY date) - 1 AS returns FROM index_bars)"""
