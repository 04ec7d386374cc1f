"""Sharding by minimax contiguous partition, in DataFrame operations alone."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import cell_of, cells_for, null_safe, seal, sealed_column, unseal, written

#: Capacities judged by one pass over the group ends: a pass narrows the search as four binary steps do.
PROBES = 15
#: So many group ends, all that can still matter, are fetched to end the search; while more are left, passes go on.
FETCH = 50_000


def fill(ends: DataFrame, capacities: list[int], floors: list[int], tops: list[int]) -> list[list[int]]:
    """For each capacity the ends of shards that are filled one after another as far as the capacity goes.

    One aggregate for each shard looks up, for all capacities, the last group end within reach."""
    at, cuts = [0] * len(capacities), [[] for _ in capacities]
    for low, top in zip(floors, tops):
        found = ends.where(F.col("end").between(low, top)).agg(
            *[F.max(F.when(F.col("end") <= at[i] + c, F.col("end"))).alias(f"c{i}") for i, c in enumerate(capacities)]).first()
        at = [max(x, y or 0) for x, y in zip(at, found)]
        for i, x in enumerate(at):
            cuts[i].append(x)
    return cuts


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int, probes: int = PROBES, fetch: int = FETCH) -> list[int]:
    """Where the shards end under the smallest capacity that ``shards`` contiguous shards can have.

    ``ends`` has ``end``, the running size after each atomic group. A capacity is feasible if filling shard after shard
    as far as it goes reaches the last group. A larger capacity never moves a cut back, so only group ends between the cuts of the
    largest capacity known to be too small and those of the smallest known to do can still matter. Passes over the table
    narrow that span until at most ``fetch`` ends are left, which end the binary search on the driver."""
    high = -(-total // shards) + largest  # always enough: a shard closes only when over total / shards is in it
    low = max(largest, -(-total // shards)) - 1  # never enough
    floors, tops = [0] * shards, [total] * shards
    if total == 0:
        return tops

    def near() -> DataFrame:
        inside = F.lit(False)
        for a, b in sorted(set(zip(floors, tops))):
            inside = inside | F.col("end").between(a, b)
        return ends.where(inside)

    while high - low > 1 and near().count() > fetch:
        tried = sorted({low + (high - low) * (i + 1) // (probes + 1) for i in range(probes)} - {low, high})
        cuts = fill(ends, tried, floors, tops)
        fits = [i for i in range(len(tried)) if cuts[i][-1] >= total]
        if fits:
            high, tops = tried[fits[0]], cuts[fits[0]]
        fails = [i for i in range(len(tried)) if not fits or i < fits[0]]
        if fails:
            low, floors = tried[fails[-1]], cuts[fails[-1]]
    if high - low == 1:
        return fill(ends, [high], floors, tops)[0]
    left = sorted(r[0] for r in near().select("end").distinct().collect())

    def cuts_of(capacity: int) -> list[int]:
        at, found = 0, []
        for _ in range(shards):
            i = bisect_right(left, at + capacity)
            at = max(at, left[i - 1] if i else 0)
            found.append(at)
        return found

    while high - low > 1:
        middle = (low + high) // 2
        if cuts_of(middle)[-1] >= total:
            high = middle
        else:
            low = middle
    return cuts_of(high)


def assign_shards(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to every row.

    Rows of equal text form an atomic group; groups stand in the order of their digest and are cut into ``shards``
    contiguous shards whose largest is as small as it can be (law ``bytes``). ``slot`` numbers a shard's rows from 0 without
    gaps. A group of any number of copies is dealt into parts by a hash of the row's id, so neither its sizes nor its
    slots are counted in one task; the parts of a group, fewer than cells, meet as one row each.

    Size is the UTF-8 length plus 1, of null text 1; null texts form one group apart from empty ones and have a null
    text_crc32. Repeated rows are rows of their own. With fewer groups than shards the last shards stay empty. Input columns
    named like an added one are replaced. An empty table gives no rows."""
    spark = docs.sparkSession
    rows, names = seal(docs)
    cells = cells_for(spark, docs.count())
    text, ident = F.col(sealed_column(names, text_column)), F.col(sealed_column(names, id_column))
    keyed = rows.select("*", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                        F.md5(null_safe(text).cast("binary")).alias("_key"), F.pmod(F.xxhash64(ident), F.lit(-(-cells // 4))).alias("_part"))
    parts = keyed.groupBy("_key", "_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")).withColumn("_cell", cell_of(F.col("_key"), cells))
    in_cell = Window.partitionBy("_cell").orderBy("_key")
    counted = written(parts.select(
        "_key", "_part", "_cell", "_bytes", "_rows", F.sum("_bytes").over(in_cell.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("_end"),
        F.sum("_bytes").over(Window.partitionBy("_cell", "_key")).alias("_group"),
        (F.sum("_rows").over(in_cell.orderBy("_key", "_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_first")))
    totals = counted.groupBy("_cell").agg(F.sum("_bytes").alias("_cell_bytes"), F.sum("_rows").alias("_cell_rows"), F.max("_group").alias("_largest"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # one row per cell
    starts = written(totals.select("_cell", "_largest", "_cell_bytes", F.coalesce(F.sum("_cell_bytes").over(before), F.lit(0)).alias("_bytes_before"),
                                   F.coalesce(F.sum("_cell_rows").over(before), F.lit(0)).alias("_rows_before")))
    placed = counted.join(starts.select("_cell", "_bytes_before", "_rows_before"), "_cell").select(
        "_key", "_part", (F.col("_bytes_before") + F.col("_end")).alias("end"), (F.col("_bytes_before") + F.col("_end") - F.col("_group")).alias("_begin"),
        (F.col("_rows_before") + F.col("_first")).alias("_first"))
    table = written(placed.repartitionByRange("end").sortWithinPartitions("end"))
    whole = starts.agg(F.sum("_cell_bytes"), F.max("_largest")).first()
    cuts = smallest_capacity(table, int(whole[0] or 0), int(whole[1] or 0), shards)
    firsts = table.agg(*[F.min(F.when(F.col("_begin") >= c, F.col("_first"))).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
    shard, base = F.lit(0), F.lit(0).cast("bigint")
    for i, c in enumerate(cuts[:-1]):
        if firsts[i] is not None:
            shard = F.when(F.col("_begin") >= c, F.lit(i + 1)).otherwise(shard)
            base = F.when(F.col("_begin") >= c, F.lit(firsts[i])).otherwise(base)
    homes = table.select("_key", "_part", shard.cast("int").alias("shard"), (F.col("_first") - base).alias("_first"))
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(ident)) - 1
    sharded = keyed.join(homes, ["_key", "_part"]).withColumns({
        "slot": (F.col("_first") + number).cast("bigint"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return unseal(sharded, names, ("size", "text_crc32", "law", "shard", "slot", "grown_shard"))
