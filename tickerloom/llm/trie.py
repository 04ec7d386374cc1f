"""The trie of conversation prefixes: which conversations begin alike, how far, and what sharing their turns saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scan import sorted_scan
from tickerloom.llm.common import seal, sealed_column, shuffle_partitions, written

#: Cells of a sketch's row: at least eight for each prefix within these bounds, so a sketch is at most 16 MB. A sketch that is too full
#: lets more prefixes through to the exact grouping, it loses none.
SKETCH_CELLS = (1 << 12, 1 << 26)
ROWS = 2
#: Cells that are counted together, and characters of one piece of a list of ids.
BLOCK_BITS, PIECE_CHARS = 16, 1 << 18
LOW = 0xFFFFFFFF


def number_turns(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv, at, n, one, two, chars): every turn's place from 1 on in its conversation of n turns, a 128-bit digest of its role and text, and
    the text's code points.

    Turns stand in the order of ``turn``, nulls first; rows of the same turn in the order of their digests. Null roles and texts are empty ones. Rows with a
    null id belong to no conversation and are left out. A conversation of any length is numbered in ranges by many tasks."""
    rows, names = seal(turns)
    conv, turn, role, text = (F.col(sealed_column(names, c)) for c in (id_column, turn_column, role_column, text_column))
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    told = rows.where(conv.isNotNull()).select(conv.alias("conv"), turn.isNotNull().alias("known"), turn.alias("turn"), F.char_length(text).cast("long").alias("chars"),
                                               F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"))
    numbered = sorted_scan(told, ["conv"], ["known", "turn", "digest"], {"at": F.lit(1)}, totals=True)
    half = lambda first: F.conv(F.substring("digest", first, 16), 16, -10).cast("long")
    return numbered.select("conv", "at", F.col("at_total").alias("n"), half(1).alias("one"), half(17).alias("two"), "chars")


def hash_cells(one: np.ndarray, two: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each prefix in every row of a sketch."""
    a, b = one.view(np.uint64), two.view(np.uint64)
    shift = np.uint64(64 - (cells.bit_length() - 1))
    return [((a ^ (b << np.uint64(r + 1) | b >> np.uint64(63 - r))) * np.uint64(0x9E3779B97F4A7C15 + 2 * r) >> shift).astype(np.int64) for r in range(ROWS)]


def cell_counter(cells: int):
    """A task's prefixes as (block, once, more): which cells of the block it has met once, and which more often."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            met = np.sort(np.concatenate([c + r * cells for r, c in enumerate(hash_cells(one, two, cells))]))
            cell, count = np.unique(met, return_counts=True)
            block = cell >> BLOCK_BITS
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(cell) else np.zeros(0, np.int64)
            low, out = (cell & ((1 << BLOCK_BITS) - 1)).astype("<u2"), ([], [], [])
            for s, e in zip(starts, [*starts[1:], len(cell)], strict=False):
                for column, value in zip(out, (int(block[s]), low[s:e][count[s:e] == 1].tobytes(), low[s:e][count[s:e] > 1].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["block", "once", "more"])

    return counted


def merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the bits of cells with a count above one; counts stop at two, so a block's counters are as many bytes as it has cells."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held = counts.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
            for cells, n in ((once, 1), (more, 2)):
                at = np.frombuffer(cells, "<u2")
                held[at] = np.minimum(held[at] + n, 2)
    keep = {b: np.packbits(c > 1, bitorder="little").tobytes() for b, c in counts.items() if (c > 1).any()}
    yield pa.RecordBatch.from_arrays([pa.array(keep.keys(), pa.int64()), pa.array(keep.values(), pa.binary())], names=["block", "bits"])


def shared_cells(prefixes: DataFrame, cells: int) -> np.ndarray:
    """The sketch as one bit for each cell: whether its count is above one. Tasks count their own prefixes first."""
    counted = prefixes.select("p1", "p2").mapInArrow(cell_counter(cells), "block long, once binary, more binary")
    blocks = counted.repartition("block").mapInArrow(merge_blocks, "block long, bits binary")
    bits = np.zeros(max(ROWS * cells, 1 << BLOCK_BITS) // 8, np.uint8)
    step = (1 << BLOCK_BITS) // 8
    for block, held in blocks.collect():  # at most 16 MB
        own = np.frombuffer(held, np.uint8)[:max(0, len(bits) - block * step)]
        bits[block * step:block * step + len(own)] = own
    return bits


def screen(sketch, cells: int):
    """Adds ``state`` to prefixes: 0 if a shorter prefix is proved to be met once, 1 if this is the first such one, 2 if it may be shared."""

    def shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out, bits = np.ones(len(one), bool), sketch.value
        for r, cell in enumerate(hash_cells(one, two, cells)):
            at = cell + r * cells
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("depth", "p1", "p2", "q1", "q2")}
            before = (c["depth"] == 1) | shared(c["q1"], c["q2"])
            state = np.where(before, np.where(shared(c["p1"], c["p2"]), 2, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state, pa.int32())], names=[*batch.schema.names, "state"])

    return screened


class Trie(NamedTuple):
    """``nodes``: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends); a node is named by its smallest member and depth.
    ``ends``: (conv_id, depth, member) for each conversation that ends at a node of several; one alone at a node ends there if n_ends is 1."""

    nodes: DataFrame
    ends: DataFrame


def prefix_digests(steps: DataFrame) -> DataFrame:
    """(conv, depth, n, chars, p1, p2, q1, q2): digests of every prefix and of the one before it, sums of hashes of the turns in their places. Running
    sums are taken over ranges, so a conversation of any length is spread over tasks."""
    one, two = F.xxhash64("depth", "one", "two"), F.xxhash64(F.lit("second"), "two", "depth", "one")
    parts = {f"s{i}": F.shiftrightunsigned(h, 32 * (i % 2)).bitwiseAND(F.lit(LOW)) for i, h in enumerate((one, one, two, two))}
    own = steps.select("conv", "depth", "n", "chars", *[p.alias(f"h{n}") for n, p in parts.items()])
    summed = sorted_scan(own, ["conv"], ["depth"], {n: f"h{n}" for n in parts})

    def joined(value, i: int) -> Column:
        low, high = (value(f"s{j}").bitwiseAND(F.lit(LOW)) for j in (i, i + 1))
        return F.shiftleft(high, 32).bitwiseOR(low)

    now, before = (lambda n: F.col(n)), (lambda n: F.col(n) - F.col(f"h{n}"))
    return summed.select("conv", "depth", "n", "chars", joined(now, 0).alias("p1"), joined(now, 2).alias("p2"), joined(before, 0).alias("q1"), joined(before, 2).alias("q2"))


def trie(steps: DataFrame, convs: DataFrame) -> Trie:
    """The trie of the conversations ``convs`` (conv, n; n may be 0) with the turns ``steps`` (conv, depth from 1 to n, n, one, two, chars).

    A Count-min sketch of all prefix digests is put together first. An estimate of one proves that a conversation is alone from there on: its rows are
    finished where they stand. Only prefixes that may be shared are shuffled and grouped exactly.

    A node is named by its smallest member, so the nodes of one name lie one below the other: a chain. A conversation that names nodes adds its leaf and
    its chain's savings to the deepest node of every chain on its way down; running sums up the chains then give each node's
    subtree, whatever its depth, without a loop over depths."""
    spark = steps.sparkSession
    prefixes = written(prefix_digests(steps))
    total = prefixes.count()
    cells = min(max(1 << (8 * total).bit_length(), SKETCH_CELLS[0]), SKETCH_CELLS[1])
    sketch = spark.sparkContext.broadcast(shared_cells(prefixes, cells))
    state = ", ".join(f"{n} {t}" for n, t in prefixes.dtypes) + ", state int"
    screened = prefixes.mapInArrow(screen(sketch, cells), state)
    first = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.sum((F.col("n") == 0).cast("long")).alias("ends")).first()
    root_conv, root_n, root_ends = first["conv"], first["n"], first["ends"]
    kind = convs.schema["conv"].dataType
    root_name = F.lit(root_conv).cast(kind)

    alone = screened.where("state = 0").select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), (F.col("depth") == F.col("n")).cast("long").alias("n_ends"))

    few = written(screened.where("state > 0").drop("q1", "q2"))
    maybe = few.where("state = 2").drop("state")
    grouped = written(maybe.groupBy("depth", "p1", "p2").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("name"), F.min("chars").alias("chars"),
                                                            F.sum((F.col("n") == F.col("depth")).cast("long")).alias("n_ends")))
    named = written(maybe.select("conv", "depth", "n", "p1", "p2").join(grouped.select("depth", "p1", "p2", "name", "n_convs"), ["depth", "p1", "p2"]).drop("p1", "p2"))

    single = few.where("state = 1").select(F.col("conv").alias("name"), "depth", F.lit(1).cast("long").alias("n_convs"), "chars", (F.col("n") == F.col("depth")).cast("long").alias("n_ends"))
    above = named.select(F.col("conv").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("n_convs").alias("parent_n"))
    # without a row above, the prefix above is proved to be the conversation's alone
    nodes = written(grouped.select("name", "depth", "n_convs", "chars", "n_ends").unionByName(single).join(above, ["name", "depth"], "left").select(
        "name", "depth", "n_convs", "chars", "n_ends", F.when(F.col("depth") == 1, root_name).otherwise(F.coalesce("parent", "name")).alias("parent"),
        F.when(F.col("depth") == 1, F.lit(2)).otherwise(F.coalesce("parent_n", F.lit(1))).alias("parent_n")))

    root = spark.range(1 if root_n else 0).select(root_name.alias("name"), F.lit(0).cast("long").alias("depth"), F.lit(root_n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"),
                                                  F.lit(root_ends).cast("long").alias("n_ends"), F.lit(None).cast(kind).alias("parent"))
    children = nodes.groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    shared = written(nodes.where("n_convs > 1").drop("parent_n").unionByName(root).join(children, ["name", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn(
        "own", (F.col("n_convs") - 1) * F.col("chars")))

    none = F.lit(0).cast("long")
    owners = nodes.where("n_convs = 1 and parent_n > 1").select(F.col("name").alias("conv"), F.lit(1).cast("long").alias("leaf"), none.alias("saved")).unionByName(
        shared.select(F.col("name").alias("conv"), (F.col("n_children") == 0).cast("long").alias("leaf"), F.col("own").alias("saved"))).groupBy("conv").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    passed = named.where("n_convs > 1").select("conv", "name", "depth").unionByName(convs.select("conv", root_name.alias("name"), none.alias("depth"))).groupBy("conv", "name").agg(F.max("depth").alias("depth"))
    added = passed.join(owners, "conv").groupBy("name", "depth").agg(F.sum("leaf").alias("leaves"), F.sum(F.when(F.col("name") != F.col("conv"), F.col("saved")).otherwise(none)).alias("more"))
    points = shared.join(added, ["name", "depth"], "left").select(
        "*", (-F.col("depth")).alias("up"), F.coalesce("leaves", none).alias("leaf"), (F.col("own") + F.coalesce("more", none)).alias("saved"))
    several = sorted_scan(points, ["name"], ["up"], {"n_leaves": "leaf", "saved_tokens": "saved"})

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"]
    lone = nodes.where("n_convs = 1").select(F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", (1 - F.col("n_ends")).alias("n_children"),
                                             F.lit(1).cast("long").alias("n_leaves"), none.alias("saved_tokens"), "n_ends")
    whole = alone.select(columns).unionByName(lone.select(columns)).unionByName(several.withColumnsRenamed({"name": "conv_id", "parent": "parent_conv_id"}).select(columns))
    ends = named.where("n_convs > 1 and depth = n").select(F.col("name").alias("conv_id"), "depth", F.col("conv").alias("member")).unionByName(
        convs.where("n = 0").select(root_name.alias("conv_id"), none.alias("depth"), F.col("conv").alias("member")))
    return Trie(whole, ends)


def prefix_trie(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> Trie:
    """The trie of all conversations of a table of turns.

    Nulls in roles and texts are empty strings, null turns come first, rows of the same turn stand in a fixed order, repeated rows are turns of their own,
    rows with a null id belong to no conversation. Texts of any length are digested where they are read. Other columns are ignored,
    whatever they are called. An empty table gives no nodes."""
    steps = number_turns(turns, id_column, turn_column, role_column, text_column).withColumnRenamed("at", "depth")
    return trie(steps, steps.where("depth = 1").select("conv", "n"))


def with_borrowed_heads(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Steps and conversations as ``trie`` takes them, of ``number_turns``' conversations rebuilt: the first h turns are those of the conversation
    ``conv - conv % group`` (all if it has fewer, none if it is absent), the own turns behind the first h follow; h is the id's CRC-32 modulo ``heads``.

    At most ``heads - 1`` turns of a lending conversation are gathered."""
    own = written(turns)
    lent = own.where((F.col("conv") % group == 0) & (F.col("at") < heads)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "one", "two", "chars"))).alias("lent"))
    counted = own.groupBy("conv").agg(F.max("n").alias("had")).withColumns({"h": F.crc32(F.col("conv").cast("string")) % heads, "base": F.col("conv") - F.col("conv") % group})
    taken = F.least(F.col("h"), F.size(F.coalesce("lent", F.array())).cast("long"))
    plans = written(counted.join(lent, "base", "left").withColumn("k", taken).withColumn("n", F.col("k") + F.greatest(F.col("had") - F.col("h"), F.lit(0))))
    borrowed = plans.select("conv", "n", F.explode(F.slice("lent", F.lit(1), F.col("k").cast("int"))).alias("t")).select("conv", F.col("t.at").cast("long").alias("depth"), "n", "t.one", "t.two", "t.chars")
    kept = own.drop("n").join(plans.select("conv", "h", "k", "n"), "conv").where("at > h").select("conv", (F.col("k") + F.col("at") - F.col("h")).alias("depth"), "n", "one", "two", "chars")
    return borrowed.unionByName(kept), plans.select("conv", "n")


def list_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, depth, member) as pieces of comma-joined members, each with its first member."""
    key, members, size = None, [], 0
    out: list[tuple] = []

    def take(batch_type) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, batch_type, strict=True)], names=["conv_id", "depth", "member", "piece"])

    for batch in batches:
        types = [batch.schema.field(0).type, pa.int64(), batch.schema.field(2).type, pa.string()]
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if row[:2] != key or size >= PIECE_CHARS:
                if members:
                    out.append((*key, members[0], ",".join(map(str, members))))
                key, members, size = row[:2], [], 0
            members.append(row[2])
            size += 20
        yield take(types)
    if members:
        out.append((*key, members[0], ",".join(map(str, members))))
        yield take(types)


def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of every node's list, whose pieces come in order; nothing but the digest's state is kept."""
    key, state = None, None
    for batch in batches:
        done = []
        for conv, depth, _, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (conv, depth) != key:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (conv, depth), hashlib.sha256(piece.encode())
            else:
                state.update(f",{piece}".encode())
        types = [batch.schema.field(0).type, pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 3, types, strict=True)], names=["conv_id", "depth", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, state.hexdigest()), types, strict=True)], names=["conv_id", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): the SHA-256 of each node's ending members, ascending and comma-joined. Members are joined to pieces in ranges over (node,
    member) by many tasks; the digest, which has to read them in order, streams over the pieces."""
    kind = ends.schema["conv_id"].dataType.simpleString()
    parts = shuffle_partitions(ends.sparkSession)
    ranged = ends.repartitionByRange(parts, "conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    pieces = ranged.mapInArrow(list_pieces, f"conv_id {kind}, depth long, member {kind}, piece string")
    dealt = pieces.repartition(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member")
    return dealt.mapInArrow(hash_pieces, f"conv_id {kind}, depth long, ends_sha256 string")
