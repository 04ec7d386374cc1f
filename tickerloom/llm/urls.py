"""URL rules by sort-merge range join, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import seal, sealed_column, shuffle_partitions, unseal, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or number sign, A to Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or number sign."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column, labels: Column) -> Column:
    """The last ``labels`` labels of the host in reverse order: a parent domain's key."""
    return F.array_join(F.slice(F.reverse(F.split(host, r"\.")), F.lit(1), labels), ".")


def event(depth: Column, key: Column, end: bool = False) -> Column:
    """Sorts by number of labels, then by key; an end sorts behind all keys that begin with its own, for no text has the byte FF."""
    parts = [F.encode(F.lpad(depth.cast("string"), 4, "0"), "UTF-8"), F.encode(key, "UTF-8")]
    return F.concat(*parts, *([F.unhex(F.lit("FF"))] if end else []))


def rule_events(rules: DataFrame) -> DataFrame:
    """(depth, at, kind, top): where the intervals of the rules begin and end, and which rule is on top of the stack from there on.

    A rule's key is its reversed host and its path; what it fits, among keys of as many labels, are those its key is a prefix of, an
    interval. Two intervals nest or lie apart, so under an end the stack's top is the rule's parent: the longest rule of the same host whose path is a
    proper prefix. Rules of the same host and path are one; ``block`` wins."""
    unique = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        "*", F.size(F.split("host", r"\.")).alias("depth"), F.concat("host", "path").alias("rule"),
        F.concat(host_key(F.col("host"), F.size(F.split("host", r"\."))), "path").alias("key"))
    prefixes = unique.select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("part")).where("part <> path")
    parents = prefixes.join(unique.select("host", F.col("path").alias("part"), F.struct(F.length("rule").alias("long"), "rule", "verdict").alias("over")), ["host", "part"]) \
        .groupBy("host", "path").agg(F.max("over").alias("over"))
    both = unique.join(parents, ["host", "path"], "left")
    own = F.struct(F.length("rule").alias("long"), "rule", "verdict")
    none = F.struct(F.lit(0).alias("long"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    begin = both.select("depth", event(F.col("depth"), F.col("key")).alias("at"), F.lit(0).alias("kind"), own.alias("top"))
    end = both.select("depth", event(F.col("depth"), F.col("key"), True).alias("at"), F.lit(0).alias("kind"), F.coalesce("over", none).alias("top"))
    return begin.unionByName(end)


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url_column: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    ``rules`` has (host, path, verdict); a rule fits its host and all subdomains where the url's path begins with the rule's, the longest
    (host and path together) wins, of equally long ones the one that sorts last; where none fits, rule is null and the verdict ``otherwise``.

    A url has a key for each number of labels that some rule has: so many reversed labels of its host, and its path. Keys and the ends of
    the rules' intervals are sorted together in ranges; within a range the sweep carries the last end or beginning forward, whose
    stack top is the longest rule that holds a key. What a range finds open at its start is the last event of the ranges before it. Equal
    keys are spread over ranges by the row, so no url, host or rule makes a task large.

    A null url, or one without ://, has empty host and path and fits no rule. Repeated rows are rows of their own. Input columns named like an
    added one are replaced. Empty rules leave all to ``otherwise``; an empty table gives no rows."""
    spark = pages.sparkSession
    rows, names = seal(pages)
    url = F.col(sealed_column(names, url_column))
    parsed = rows.select(*rows.columns, host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("_row"))
    events = written(rule_events(rules))
    depths = [r[0] for r in events.select("depth").distinct().orderBy("depth").collect()]  # at most as many as a host has labels
    labels = F.size(F.split("host", r"\."))
    wanted = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: (d <= labels) & (F.col("host") != "")) if depths else F.array().cast("array<int>")
    points = parsed.select("*", F.explode_outer(wanted).alias("_depth")).select(
        *parsed.columns, F.coalesce(event(F.col("_depth"), F.concat(host_key(F.col("host"), F.col("_depth")), "path")), F.unhex(F.lit("00"))).alias("at"), F.lit(1).alias("kind"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in parsed.schema]
    together = points.withColumn("top", F.lit(None).cast(events.schema["top"].dataType)).unionByName(events.select(*blank, "at", "kind", "top"))
    ranged = written(together.withColumn("_deal", F.xxhash64("_row")).repartitionByRange(4 * shuffle_partitions(spark), "at", "kind", "_deal")
                     .withColumn("_range", F.spark_partition_id()))
    ends = ranged.groupBy("_range").agg(F.max(F.when(F.col("kind") == 0, F.struct("at", "top"))).alias("last"))
    carried = ends.select("_range", F.last("last", True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))  # a row for each range
    sweep = Window.partitionBy("_range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("_top", F.last("top", True).over(sweep)).where("kind = 1").join(carried, "_range", "left")
    top = F.coalesce("_top", "_open.top")
    best = swept.groupBy("_row").agg(F.max(F.when(top["rule"].isNotNull(), top)).alias("_best"),
                                     *[F.first(c).alias(c) for c in parsed.columns if c != "_row"])
    done = best.select("*", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))
    return unseal(done, names, ("host", "path", "rule", "verdict"))
