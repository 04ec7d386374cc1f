"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another: the root is the smallest node of its component.

    ``edges`` has columns a and b. Large stars (every node hangs its larger neighbours on its smallest one) and
    small stars (every node hangs its smaller neighbours and itself on the smallest) alternate until nothing changes, after a
    number of rounds that grows with the logarithm of the nodes. Each round is grouped minima and joins on written
    tables; no task holds a component, and a hub's edges can be split by adaptive execution. No edges give no rows."""
    table = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        table = written(hung.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        now = table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == before:
            roots = table.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return table.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = now
