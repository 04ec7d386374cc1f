"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import cell_of, cells_for, null_safe, seal, sealed_column, unseal, word_count, written


def cyclic_weights(sources: DataFrame, cycle: Sequence[float]) -> DataFrame:
    """(source, weight): sources in code point order, null last, take the weights of ``cycle`` again and again.

    One row per distinct source: the table is configuration, not data."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycled = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int"))
    return sources.select("source").distinct().select("source", cycled.alias("weight"))


def water_fill(sources: DataFrame, share: float, most_epochs: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes dealt by weight, none above ``most_epochs`` times its source, the excess
    dealt again by weight until it is gone.

    In order of cap over weight the sources below the water level are full; the level is the first at which the next
    source is not. ``sources`` has (source, weight, source_size), one row per source."""
    cap = F.lit(float(most_epochs)) * F.col("source_size")
    order = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    used = sources.select("*", cap.alias("_cap"), F.when(F.col("weight") > 0, cap / F.col("weight")).alias("_fill")).where("weight > 0")
    left = used.select(
        "*", (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_weights"))
    stop = F.min(F.when(F.col("_left") / F.col("_weights") <= F.col("_fill"), F.struct("_fill", "_left", "_weights"))).over(whole)
    level = left.select("*", stop.alias("_stop"))
    dealt = F.col("weight") * F.col("_stop._left") / F.col("_stop._weights")
    return level.select("source", "weight", "source_size", F.least(F.col("_cap"), F.coalesce(dealt, F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, cycle: Sequence[float] = (5, 2, 1), share: float = 1.5,
        most_epochs: float = 2.0, salt: str = "mix-1", id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source") -> DataFrame:
    """Adds size, source_size, target, taken and copies to every row.

    Each source's rows are put in the order of a hash-random key. Keys deal them into cells of bounded size; cell totals
    and their running sums per source, then a running sum inside each cell, give every row's place in the source's token
    stream, however large the source is. The stream is read in whole epochs and then cut at the source's exact budget:
    ``taken`` counts the words read from a row, repeats included, so a source's sum of ``taken`` is its target rounded
    down. ``copies`` is the same in whole documents (the one at the cut goes in if half of it does).

    ``weights`` has (source, weight); without it ``cycle`` gives the weights. A source without a weight gets none. Null
    text counts no words and null is a source of its own. A source without words has target 0. Repeated rows are
    rows of their own. Columns of the input named like an added one are replaced. An empty table gives no rows."""
    spark = docs.sparkSession
    rows, names = seal(docs)
    cells = cells_for(spark, docs.count())
    ident, source = F.col(sealed_column(names, id_column)), F.col(sealed_column(names, source_column))
    keyed = rows.select(
        "*", word_count(F.col(sealed_column(names, text_column))).alias("size"), source.alias("source"), null_safe(source).alias("_group"),
        F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(ident.cast("string"), F.lit("")))).alias("_key")
    ).withColumn("_cell", cell_of(F.col("_key"), cells))
    totals = written(keyed.groupBy("_group", "_cell").agg(F.first("source").alias("source"), F.sum("size").alias("_total")))
    sources = totals.groupBy("_group").agg(F.first("source").alias("source"), F.sum("_total").alias("source_size"))
    if weights is None:
        weights = cyclic_weights(sources, cycle)
    weighed = sources.join(weights.select(null_safe(F.col("source")).alias("_group"), F.col("weight").cast("double").alias("weight")),
                           "_group", "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    targets = water_fill(weighed, share, most_epochs).select(null_safe(F.col("source")).alias("_group"), "target")
    earlier = Window.partitionBy("_group").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_group", "_cell", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start")).join(
        sources.select("_group", "source_size").join(targets, "_group", "left"), "_group")
    inside = Window.partitionBy("_group", "_cell").orderBy("_key", ident, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.drop("source").join(starts, ["_group", "_cell"]).withColumn(
        "_before", F.col("_start") + F.sum("size").over(inside) - F.col("size"))
    quota = F.floor(F.coalesce(F.col("target"), F.lit(0.0))).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(quota / F.greatest("source_size", F.lit(1))).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    rest = quota - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("_before")))
    more = (rest > 0) & (F.col("_before") + F.col("size") / 2 <= rest)
    mixed = placed.withColumns({"target": F.coalesce(F.col("target"), F.lit(0.0)), "taken": epochs * F.col("size") + cut,
                                "copies": epochs + more.cast("bigint")})
    return unseal(mixed, names, ("size", "source_size", "target", "taken", "copies"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row as often as the mix takes it, with the columns of ``docs``."""
    mixed = mix(docs, **settings)
    return mixed.where("copies > 0").select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*docs.columns)
