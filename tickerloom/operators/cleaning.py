"""Cleaning, derived price columns and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.columns import div, finite_or_null, flag
from tickerloom.functions.series import Series, apply_stages
from tickerloom.schemas import OHLC, OHLCV, RAW_COLUMNS, TARGET_COLUMNS

STOCKS = Series(("ticker",), ("date",))
INDICES = Series(("series_id",), ("date",))


def dedupe_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``. An aggregate, not a window: copies of one key shrink on the map side."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def drop_null_ohlcv(df: DataFrame) -> DataFrame:
    return df.dropna(subset=list(OHLCV))


def filter_valid_prices(df: DataFrame) -> DataFrame:
    valid = F.col("volume") >= 0
    for c in OHLC:
        valid = valid & (F.col(c) > 0)
    return df.where(valid)


def cast_bars(df: DataFrame) -> DataFrame:
    """Bar types; what does not parse becomes NULL, and NaN becomes NULL."""
    casts = {"date": F.col("date").try_cast("date")}
    if "ticker" in df.columns:
        casts["ticker"] = F.col("ticker").cast("string")
    for c in OHLCV:
        number = F.col(c).try_cast("double")
        casts[c] = F.nanvl(number, F.lit(None).cast("double"))
    return df.withColumns({c: e for c, e in casts.items() if c in df.columns})


def clean_bars(df: DataFrame, order: Sequence[str] = (), keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Cast, fold duplicates, drop incomplete and impossible rows.

    ``order`` names the input order that decides which duplicate is last; without it the full row decides. A duplicate
    whose last copy is incomplete removes the key, because incomplete rows are dropped after folding.
    """
    typed = cast_bars(df)
    decide = list(order) or [c for c in typed.columns if c not in keys]
    folded = dedupe_keep_last(typed, keys, decide)
    return filter_valid_prices(drop_null_ohlcv(folded)).drop(*order)


def add_returns(df: DataFrame, series: Series = STOCKS) -> DataFrame:
    out = apply_stages(df, [{"returns": series.pct_change("close")}])
    return out.withColumn("log_returns", F.log1p("returns"))


def add_reference_price(df: DataFrame, series: Series = STOCKS) -> DataFrame:
    return df.withColumn("ref_price", series.shift("close"))


def flag_price_limits(df: DataFrame, limit_pct: float = 0.07, tolerance: float = 0.002,
                      series: Series = STOCKS) -> DataFrame:
    if "ref_price" not in df.columns:
        df = add_reference_price(df, series)
    move = div(F.col("close") - F.col("ref_price"), "ref_price")
    return df.withColumns({
        "is_limit_up": flag(move >= F.lit(limit_pct - tolerance)),
        "is_limit_down": flag(move <= F.lit(-limit_pct + tolerance)),
    })


def flag_suspended(df: DataFrame) -> DataFrame:
    return df.withColumn("is_suspended", flag(F.col("volume") == 0))


def derive_bar_columns(df: DataFrame, limit_pct: float = 0.07, tolerance: float = 0.002,
                       series: Series = STOCKS) -> DataFrame:
    """Returns, reference price and flags of already clean bars, from a single lag of the close."""
    out = add_reference_price(df, series)
    out = out.withColumn("returns", div("close", "ref_price") - 1)
    out = out.withColumn("log_returns", F.log1p("returns"))
    return flag_suspended(flag_price_limits(out, limit_pct, tolerance, series))


def process_bars(raw: DataFrame, limit_pct: float | None = None, tolerance: float = 0.002,
                 order: Sequence[str] = ()) -> DataFrame:
    return derive_bar_columns(clean_bars(raw, order), 0.07 if limit_pct is None else limit_pct, tolerance)


def process_index(raw: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Index bars keyed by (series_id, date); a single unnamed index gets series_id 'IDX'."""
    if "series_id" not in raw.columns:
        raw = raw.withColumn("series_id", F.lit("IDX"))
    folded = clean_bars(raw, order, keys=("date", "series_id"))
    return add_returns(folded, INDICES)


def bar_counts(processed: DataFrame) -> DataFrame:
    """Row, ticker, date and limit counts of a processed panel."""
    return processed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.countDistinct("date").alias("n_dates"),
        F.sum("is_limit_up").alias("n_limit_up"),
        F.sum("is_limit_down").alias("n_limit_down"),
        F.sum("is_suspended").alias("n_suspended"),
    )


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RAW_COLUMNS and c not in TARGET_COLUMNS]


def downcast_float(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    chosen = doubles if columns is None else doubles & set(columns)
    return df.withColumns({c: F.col(c).cast("float") for c in sorted(chosen)})


def inf_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(c) for c in columns})


def nan_to_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in columns})


def date_range_split(df: DataFrame, start, end) -> DataFrame:
    """Inclusive date range; reaches the scan as a pushed filter."""
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def recent_window(df: DataFrame, years: int = 2) -> DataFrame:
    """Rows of the last ``years`` before the latest date. The cut is a scalar subquery."""
    cut = df.agg(F.add_months(F.max("date"), -12 * years).alias("cut")).scalar()
    return df.where(F.col("date") >= cut)


def count_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
