"""Dataset profiles, metric integrity rules and source linting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions.scan import exact_quantiles, most_frequent

# Metric values known to be fallbacks of an old script.
KNOWN_BAD = {"precision": 0.61, "recall": 0.57, "sharpe": 1.42, "max_drawdown": -0.135, "dm_pvalue": 0.028}
# Plausible ranges by name part.
RANGES = {
    "auc": (0.0, 1.0), "precision": (0.0, 1.0), "recall": (0.0, 1.0), "f1": (0.0, 1.0), "accuracy": (0.0, 1.0),
    "sharpe": (-10.0, 10.0), "max_drawdown": (-1.0, 0.0), "p_value": (0.0, 1.0), "pvalue": (0.0, 1.0),
}
# Source patterns that look like hard-coded metrics.
LINT_PATTERNS = (
    r"if\s+\w+\s*==\s*0\s*:\s*\w+\s*=\s*[-]?[\d.]+",
    r"\b(?:prec|precision|recall|sharpe|dm_pvalue)\s*[:=]\s*(?:0\.61|0\.57|1\.42|0\.028|-0\.135)\b",
    r"(?i)#.*(?:realistic|demo|presentation|scholarship)",
)
# Name parts of likely targets.
TARGET_WORDS = ("label", "target", "direction", "class", "y", "close_change", "fwd_return")

NUMERIC, CATEGORICAL, BOOLEAN, DATETIME, TEXT, UNKNOWN = (
    "numeric", "categorical", "boolean", "datetime", "text", "unknown")


# metric integrity -----------------------------------------------------------------------------------------------
def metrics_integrity(metrics: DataFrame) -> DataFrame:
    """Failed checks of a long (context, name, value) table, one row per failed check. The rules are a literal array per
    row, so the check is a projection without a join."""
    name, value = F.lower("name"), F.col("value")
    is_p = name.contains("p_value") | name.contains("pvalue")
    degenerate = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))

    def failed(when: Column, check: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.lit(check))

    checks = [failed(value.isNull(), "null_check")]
    checks += [failed(name.contains(n) & (F.abs(value - F.lit(v)) < 1e-10), "fabrication_check") for n, v in KNOWN_BAD.items()]
    checks.append(failed(degenerate, "nan_inf_check"))
    sound = value.isNotNull() & ~degenerate
    checks += [failed(sound & name.contains(n) & ((value < lo) | (value > hi)), "range_check")
               for n, (lo, hi) in RANGES.items()]
    digits = F.length(F.substring_index(F.rtrim(F.format_string("%.10f", value), F.lit("0")), ".", -1))
    rounded = (sound & ~value.isin(0.0, 1.0, -1.0) & ~is_p & (F.abs(value) > 0.01) & (digits <= 2))
    checks.append(failed(rounded, "roundness_check"))
    found = F.explode(F.array_compact(F.array(*checks))).alias("check")
    return metrics.select("context", "name", "value", found)


def integrity_report(metrics: DataFrame) -> DataFrame:
    """Pass flag and failure count per context; contexts without failures pass."""
    failures = metrics_integrity(metrics).groupBy("context").agg(F.count(F.lit(1)).alias("n_failed"))
    contexts = metrics.groupBy("context").agg(F.count(F.lit(1)).alias("n_metrics"))
    joined = contexts.join(failures, "context", "left").na.fill(0, ["n_failed"])
    passed = F.col("n_failed") == 0
    text = F.format_string("%s: %d of %d metrics, %d failed checks", F.when(passed, "PASSED").otherwise("FAILED"),
                           F.col("n_metrics"), F.col("n_metrics"), F.col("n_failed"))
    return joined.select("context", "n_metrics", "n_failed", passed.alias("passed"), text.alias("summary"))


def lint_hardcoded_metrics(lines: DataFrame) -> DataFrame:
    """Source lines matching a suspicious pattern; ``lines`` has path, line_no and line."""
    stripped = F.trim(F.regexp_replace("line", r"[\t\r]", " "))
    notice = stripped.startswith("#") & stripped.contains("DEPRECATED")
    hit = F.lit(False)
    for pattern in LINT_PATTERNS:
        hit = hit | stripped.rlike(pattern)
    return lines.where(hit & ~notice).select("path", "line_no", stripped.alias("line"))


# profiles -------------------------------------------------------------------------------------------------------
def _is(kind: type, field: T.StructField) -> bool:
    return isinstance(field.dataType, kind)


def column_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """total, missing and unique per column in one scan. ``approximate`` replaces the exact distinct counts, which shuffle
    every distinct (column, value) once, for very wide or very long tables."""
    names = list(columns or df.columns)
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    measures = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("total_count"),
                         F.count_if(F.col(c).isNull()).alias("missing_count"), distinct(F.col(c)).alias("unique_count")
                         ).alias(c) for c in names]
    wide = df.agg(*measures)
    return wide.select(F.explode(F.array(*[F.col(f"`{c}`") for c in names])).alias("_r")).select("_r.*")


def infer_column_kinds(df: DataFrame) -> DataFrame:
    """Kind of each column, first rule that fits: timestamp or date; strings whose values all have eight or more
    characters and parse as timestamps; boolean, or two values out of 0/1/true/false; numeric; text (over three words
    on average) or categorical; unknown."""
    fields = {f.name: f for f in df.schema.fields}
    strings = [n for n, f in fields.items() if _is(T.StringType, f)]
    simple = [n for n, f in fields.items() if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    measures = []
    for n in simple:
        value = F.col(n).cast("string")
        words = F.size(F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " "))
        measures.append(F.struct(
            F.lit(n).alias("column"), F.count(n).alias("n_values"), F.countDistinct(n).alias("n_unique"),
            F.min(value.isin("0", "1", "0.0", "1.0", "True", "False", "true", "false")).alias("flags_only"),
            F.avg(F.when(F.trim(value) == "", 0).otherwise(words)).alias("mean_words"),
            (F.min((F.length(value) >= 8) & value.try_cast("timestamp").isNotNull()) if n in strings else F.lit(False)).alias("dates_only")).alias(n))
    wide = df.agg(*measures)
    facts = wide.select(F.explode(F.array(*[F.col(f"`{n}`") for n in simple])).alias("_r")).select("_r.*")
    typed = {"d": [], "b": [], "n": [], "s": strings}
    for n in simple:
        f = fields[n]
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            typed["d"].append(n)
        elif _is(T.BooleanType, f):
            typed["b"].append(n)
        elif isinstance(f.dataType, T.NumericType):
            typed["n"].append(n)
    kind = (F.when(F.col("column").isin(typed["d"]) | F.coalesce("dates_only", F.lit(False)), DATETIME)
            .when(F.col("column").isin(typed["b"]) | ((F.col("n_unique") == 2) & F.col("flags_only")), BOOLEAN)
            .when(F.col("column").isin(typed["n"]), NUMERIC)
            .when(F.col("column").isin(typed["s"]) & (F.col("mean_words") > 3.0), TEXT)
            .when(F.col("column").isin(typed["s"]), CATEGORICAL).otherwise(UNKNOWN))
    known = facts.select("column", kind.alias("kind"))
    odd = [n for n in fields if n not in simple]
    if odd:
        known = known.unionByName(df.sparkSession.createDataFrame([(n, UNKNOWN) for n in odd], "column string, kind string"))
    return known


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    measures = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                         F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c)
                for c in columns]
    wide = df.agg(*measures).select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("_r")).select("_r.*")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    tall = df.select(pairs.alias("_p")).select("_p.column", "_p.v")
    return wide.join(exact_quantiles(tall, ["column"], "v", {"median": 0.5}), "column", "left")


def category_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]))
    tall = df.select(pairs.alias("_p")).select("_p.column", "_p.v")
    return most_frequent(tall, ["column"], "v", "most_frequent", "most_frequent_frequency")


def datetime_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fmt = "yyyy-MM-dd HH:mm:ss"
    measures = []
    for c in columns:
        t = F.col(c).try_cast("timestamp")
        measures.append(F.struct(F.lit(c).alias("column"), F.date_format(F.min(t), fmt).alias("min_date"),
                                 F.date_format(F.max(t), fmt).alias("max_date")).alias(c))
    return df.agg(*measures).select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("_r")).select("_r.*")


def infer_schema(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Profile: kind and statistics per column as a long table. The kinds, one row per column, are fetched to decide which
    statistics apply unless they are given."""
    if kinds is None:
        kinds = {r["column"]: r["kind"] for r in infer_column_kinds(df).collect()}
    simple = [c for c in df.columns if kinds[c] != UNKNOWN]
    of = lambda *wanted: [c for c in simple if kinds[c] in wanted]
    kind = F.lit(UNKNOWN)
    for c, v in kinds.items():
        kind = F.when(F.col("column") == c, v).otherwise(kind)
    out = column_counts(df, simple).withColumn("type", kind).withColumn(
        "missing_ratio", F.coalesce(F.try_divide(F.col("missing_count"), F.col("total_count")), F.lit(0.0)))
    parts = []
    if of(NUMERIC):
        parts.append((numeric_stats(df, of(NUMERIC)), ("mean", "std", "min", "max", "median")))
    if of(CATEGORICAL, BOOLEAN):
        parts.append((category_stats(df, of(CATEGORICAL, BOOLEAN)), ("most_frequent", "most_frequent_frequency")))
    if of(DATETIME):
        parts.append((datetime_stats(df, of(DATETIME)), ("min_date", "max_date")))
    for part, _ in parts:
        # One row per column of the profiled table.
        out = out.join(F.broadcast(part), "column", "left")
    return out


def profile_json(profile: DataFrame) -> DataFrame:
    """One JSON document per column; NULL fields are left out."""
    rest = [c for c in profile.columns if c not in ("column", "type")]
    return profile.select("column", F.to_json(F.struct("type", F.struct(*rest).alias("statistics"))).alias("profile"))


def suggest_target(columns: Sequence[str]) -> str | None:
    """First column whose name holds a target word; looks at names only."""
    return next((c for c in columns if any(w in c.lower() for w in TARGET_WORDS)), None)


def suggest_problem_type(profile: DataFrame, target: str) -> DataFrame:
    """Problem type of every choice of target: NLP, classification, forecasting (a datetime column exists), regression."""
    has_dates = profile.agg(F.max((F.col("type") == DATETIME).cast("int")).alias("d")).scalar()
    kind = F.col("type")
    problem = (F.when(kind == TEXT, "nlp")
               .when(kind.isin(CATEGORICAL, BOOLEAN) & (F.col("unique_count") == 2), "binary_classification")
               .when(kind.isin(CATEGORICAL, BOOLEAN), "multiclass_classification")
               .when((kind == NUMERIC) & (has_dates == 1), "forecasting").when(kind == NUMERIC, "regression")
               .otherwise("unknown"))
    rows = profile if target == "*" else profile.where(F.col("column") == target)
    return rows.select("column", problem.alias("problem_type"))
