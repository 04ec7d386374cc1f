"""Running totals and order statistics that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import stored

#: Ranges for each shuffle partition of the session: a group with all rows still has ranges of a few per cent.
RANGES = 4


def ranges_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``_range``: ranges of about equal size over (keys, order), numbered in that order, read and written once.

    Spark's range partitioning samples the rows to place the cuts; a null is a value like others."""
    parts = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys are equal; the keys of ``right`` go."""
    other = right.toDF(*[f"_r_{c}" if c in keys else c for c in right.columns])
    condition = F.lit(True)
    for c in keys:
        condition = condition & left[c].eqNullSafe(other[f"_r_{c}"])
    return left.join(other, condition).drop(*[f"_r_{c}" for c in keys])


def sorted_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column | str],
                totals: bool = False) -> DataFrame:
    """Adds the running sum of each ``sums`` entry in ascending ``order`` within ``keys``.

    A plain window would sort one group in one task. Here rows are dealt to ranges over (keys, order), so a large group spreads
    over many ranges; ranges are scanned independently and shifted by the total of the group's ranges before them.
    The result is exact wherever the cuts fall. Null keys form a group. ``order`` must be unique within ``keys``; fold
    ties first. ``keys`` may be empty.
    """
    base = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_in_{n}") for n, c in sums.items()])
    group = list(keys)
    ranged = ranges_of(base, group, order)
    per_range = ranged.groupBy(*group, "_range").agg(*[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in sums])
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_range.select(
        *group, "_range",
        *[F.sum(f"_tot_{n}").over(before).alias(f"_off_{n}") for n in sums],
        *([F.sum(f"_tot_{n}").over(whole).alias(f"{n}_total") for n in sums] if totals else []))
    local = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = ranged.select("*", *[F.sum(f"_in_{n}").over(local).alias(f"_run_{n}") for n in sums])
    joined = same_keys(scanned, shifts, [*group, "_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_run_{n}") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(n) for n in sums],
        *([F.col(f"{n}_total") for n in sums] if totals else []))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per group, exact at any group size."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    scanned = sorted_scan(counts, keys, ["_v"], {"_cum": "_n"}, totals=True)
    picks = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_cum_total") - 1)
        for part, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (rank >= F.col("_cum") - F.col("_n")) & (rank < F.col("_cum"))
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{name}_{part}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_w"))
    picked = scanned.groupBy(*keys).agg(*picks)
    return picked.select(*keys, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n) for n in quantiles])


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode", out_count: str | None = None
                  ) -> DataFrame:
    """Most frequent non-null value per group, smallest on ties; counts are combined on the map side."""
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_v").alias("v"))).alias("_b"))
    columns = [F.col("_b.v").alias(out)]
    if out_count:
        columns.append((-F.col("_b.neg")).alias(out_count))
    return best.select(*keys, *columns)
