"""Column contracts of the tables the engine reads and writes."""

from pyspark.sql import types as T

BARS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

INDEX_BARS = T.StructType([T.StructField("series_id", T.StringType())] + [
    f for f in BARS.fields if f.name != "ticker"])

FOLDS = T.StructType([
    T.StructField("fold", T.IntegerType()),
    T.StructField("train_start", T.DateType()),
    T.StructField("train_end", T.DateType()),
    T.StructField("test_start", T.DateType()),
    T.StructField("test_end", T.DateType()),
])

OHLC = ("open", "high", "low", "close")
OHLCV = OHLC + ("volume",)

# Columns that are never model inputs.
RAW_COLUMNS = frozenset({
    "date", "ticker", "open", "high", "low", "close", "volume", "adj_close", "returns", "log_returns",
    "ref_price", "is_limit_up", "is_limit_down", "is_suspended",
})
TARGET_COLUMNS = frozenset({"fwd_return", "label"})

PREDICTION_COLUMNS = ("fold", "date", "ticker", "model", "y_true", "y_proba", "y_pred", "regime")
