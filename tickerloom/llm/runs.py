"""Periodic runs of words: stretches that repeat themselves, found as maximal pairs of an LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm.common import seal, sealed_column, unseal

#: Words of several texts that are sorted together; a longer text stands alone.
TOGETHER = 400_000
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def repeated_positions(tokens: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Positions whose next ``width`` tokens (a power of two) stand elsewhere in their text too; chance may add others, none is lost."""
    h = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX[0])
    h ^= h >> np.uint64(29)
    k = 1
    while k < width:
        h = np.append(h[:-k] * np.uint64(MIX[1]) + (h[k:] ^ h[k:] >> np.uint64(31)) * np.uint64(MIX[0] + 2 * k), np.zeros(k, np.uint64))
        k *= 2
    whole = np.flatnonzero(ends - np.arange(len(tokens)) >= width)
    order = whole[np.argsort(h[whole])]
    same = h[order[1:]] == h[order[:-1]]
    return np.sort(order[np.append(same, False) | np.append(False, same)]) if len(order) else order


def grouped_ranks(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by ``keys`` (the last one first) and, along it, where the group of equal rows begins."""
    order = np.lexsort(keys)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))


def suffix_order(tokens: np.ndarray, ends: np.ndarray, chosen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``chosen`` positions in the order of their suffixes, and each one's common prefix with the one before it.

    Prefixes of ``width`` tokens are ranked first, then twice as many again and again for what is still tied (with the ranks of what stands behind);
    the ranks of every step are kept, and a common prefix is put together from the longest steps that agree."""
    n = len(tokens)
    known = np.unique(np.concatenate([chosen, chosen + width]))
    known = known[known < n]
    bits = int(tokens.max() + 2).bit_length()
    per, keys = max(1, 63 // bits), []
    for first in range(0, width, per):
        packed = np.zeros(len(known), np.int64)
        for t in range(first, min(first + per, width)):
            at = known + t
            inside = at < ends[known]
            packed = packed << bits | np.where(inside, tokens[np.minimum(at, n - 1)] + 1, 0)
        keys.append(packed)
    order, start = grouped_ranks(tuple(reversed(keys)))
    rank = np.full(n + 1, -1, np.int64)
    rank[known[order]] = start
    steps, h = [], width

    def behind(at: np.ndarray, step: int) -> np.ndarray:
        return np.where(at + step < ends[at], rank[np.minimum(at + step, n)], -1)

    sizes = np.bincount(start, minlength=len(start))
    tied = known[order][sizes[start] > 1]
    while len(tied):
        steps.append((h, rank.astype(np.int32)))
        old = rank[tied]
        order, start = grouped_ranks((behind(tied, h), old))
        tied, old = tied[order], old[order]
        head = np.ones(len(tied), bool)
        head[1:] = old[1:] != old[:-1]
        rank[tied] = old + start - np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))
        sizes = np.bincount(start, minlength=len(start))
        tied, h = tied[sizes[start] > 1], 2 * h
    chosen = chosen[np.argsort(rank[chosen])]
    a, b = chosen[:-1], chosen[1:]
    common = np.zeros(len(a), np.int64)
    for step, ranks in reversed(steps):
        inside = (a + common < ends[a]) & (b + common < ends[b])
        common += np.where(inside & (ranks[np.minimum(a + common, n)] == ranks[np.minimum(b + common, n)]), step, 0)
    going = np.ones(len(a), bool)
    for _ in range(width - 1):
        inside = (a + common < ends[a]) & (b + common < ends[b])
        going &= inside & (tokens[np.minimum(a + common, n - 1)] == tokens[np.minimum(b + common, n - 1)])
        common += going
    return chosen, np.append(0, common)


class Interval:
    """Positions whose suffixes begin alike: in order, and in a list for each word on their left."""

    __slots__ = ("positions", "by_left")

    def __init__(self, position: int, left: int):
        self.positions, self.by_left = [position], {left: [position]}


def maximal_pairs(order: list[int], common: list[int], left: list[int], shortest: int, exponent: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance) of maximal pairs that are runs, from the tree of LCP intervals, bottom up.

    Two positions of different children of an interval with common prefix l, whose left words differ, begin equal stretches of l words that
    neither side extends. With a distance d of at most l / (exponent - 1) the stretches overlap or touch to one of l + d words with period d; it is
    maximal as it stands. The smaller child looks around each of its positions in the larger one's lists. All positions within reach
    hold l words in a stretch of at most 2 l, so they step by one period, and all but the first have the same left word: the lists of the first and the last
    are all there are. A child's positions then join the larger's lists."""
    stack: list[tuple[int, Interval]] = []
    node = Interval(order[0], left[order[0]])
    for i in range(1, len(order) + 1):
        shared = common[i] if i < len(order) else 0
        if shared < shortest:
            shared = 0
        while stack and stack[-1][0] > shared:
            length, parent = stack.pop()
            large, small = (parent, node) if len(parent.positions) >= len(node.positions) else (node, parent)
            yield from _pairs(large, small, length, left, exponent, min_length)
            node = large
        if shared:
            if stack and stack[-1][0] == shared:
                length, parent = stack.pop()
                large, small = (parent, node) if len(parent.positions) >= len(node.positions) else (node, parent)
                yield from _pairs(large, small, length, left, exponent, min_length)
                node = large
            stack.append((shared, node))
        if i < len(order):
            node = Interval(order[i], left[order[i]])


def _pairs(large: Interval, small: Interval, length: int, left: list[int], exponent: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    reach, least = length // (exponent - 1), min_length - length
    every = large.positions
    for x in small.positions:
        lo, hi = bisect_left(every, x - reach), bisect_right(every, x + reach)
        if lo == hi:
            continue
        for word in {left[every[lo]], left[every[hi - 1]]} - {left[x]}:
            same = large.by_left[word]
            for y in same[bisect_left(same, x - reach):bisect_right(same, x + reach)]:
                if abs(x - y) >= least:
                    yield min(x, y), max(x, y) + length, abs(x - y)
    for x in small.positions:
        insort(every, x)
    for word, own in small.by_left.items():
        if (same := large.by_left.get(word)) is None:
            large.by_left[word] = own
        else:
            for x in own:
                insort(same, x)


def runs_of(texts: list[list], min_length: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Per list of words its runs as (start, length, period), by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    shortest = max(1, -(-min_length * (exponent - 1) // exponent))  # a run of n words has a pair with at least n (exponent - 1) / exponent in common
    long_enough = [i for i, words in enumerate(texts) if len(words) >= min_length]
    number = defaultdict(count().__next__)
    sizes = np.array([len(texts[i]) for i in long_enough], np.int64)
    if not sizes.sum():
        return [[] for _ in texts]
    words = np.fromiter((number[w] for i in long_enough for w in texts[i]), np.int64, sizes.sum())
    last = np.cumsum(sizes)
    text_of, ends = np.repeat(np.arange(len(sizes)), sizes), np.repeat(last, sizes)
    tokens = text_of * len(number) + words  # texts share no token, so no interval holds positions of two texts
    width = 1 << (shortest.bit_length() - 1)
    chosen = repeated_positions(tokens, ends, width)
    if not len(chosen):
        return [[] for _ in texts]
    used = np.unique(text_of[chosen])  # go on with these texts alone, under dense numbers
    keep = np.isin(text_of, used)
    moved = np.cumsum(keep) - 1
    shift = np.arange(len(tokens))[keep] - moved[keep]
    tokens, ends, text_of, chosen = np.unique(tokens[keep], return_inverse=True)[1], ends[keep] - shift, text_of[keep], moved[chosen]
    order, common = suffix_order(tokens, ends, chosen, width)
    first = np.append(True, text_of[1:] != text_of[:-1])
    left = np.where(first, -1 - np.arange(len(tokens)), np.append(-1, tokens[:-1])).tolist()
    begins = (last - sizes)[text_of]
    offset = np.arange(len(tokens)) + shift - begins
    for start, end, distance in maximal_pairs(order.tolist(), common.tolist(), left, shortest, exponent, min_length):
        runs, at = found[long_enough[text_of[start]]], int(offset[start])
        key = (at, at + end - start)
        runs[key] = min(distance, runs.get(key, distance))  # a multiple of the smallest period gives the same stretch
    return [sorted((s, e - s, d) for (s, e), d in runs.items()) for runs in found]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside every run's repeats, which are all its words but those of its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth).tolist(), strict=False) if not d]


def run_finder(text_at: int, min_length: int, exponent: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            begin = 0
            while begin < len(texts):
                end, total, group = begin, 0, []
                while end < len(texts) and (not group or total < TOGETHER):
                    group.append((texts[end].as_py() or b"").split())  # splits at blank and tab to carriage return, as the pattern of a word does
                    total += len(group[-1])
                    end += 1
                runs = runs_of(group, min_length, exponent)
                added = [pa.array(map(len, group), pa.int64()), pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kind),
                         pa.array([b" ".join(kept_words(w, r)) for w, r in zip(group, runs, strict=True)], pa.binary()).cast(pa.string())]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*batch.schema.names, "n_words", "runs", "collapsed"])
                begin = end

    return found


def periodic_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, text_column: str = "text") -> DataFrame:
    """Adds to every row ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``, the words that no run repeats.

    A run is a stretch of consecutive words with smallest period q, at least ``min_length`` and ``min_exponent`` times q long, that no neighbouring
    word extends keeping that period. Runs are the maximal pairs of equal stretches whose distance is small against their length; they are
    enumerated bottom up along the tree of LCP intervals of a text's suffixes, of which only those with
    ``min_length * (1 - 1 / min_exponent)`` common words or more are visited. ``collapsed`` joins by one blank the words that are in no run behind its first period.

    Words are runs of characters other than blank and tab to carriage return. Texts of many rows are sorted together for speed; each is judged for itself, in its
    row's task, without a shuffle. A null or empty text has no words, no runs and an empty ``collapsed``. Repeated rows are judged each.
    Columns of the added names are replaced. An empty table gives no rows. ``min_exponent`` is 3 or more, ``min_length`` 2 or more."""
    if min_exponent < 3 or min_length < 2:
        raise ValueError("min_exponent is at least 3, min_length at least 2")
    rows, names = seal(docs)
    text = sealed_column(names, text_column)
    added = T.StructType.fromDDL(f"n_words bigint, runs {RUN}, collapsed string")
    read = rows.withColumn(text, F.col(text).cast("string"))
    at = read.columns.index(text)
    return unseal(read.mapInArrow(run_finder(at, min_length, min_exponent), T.StructType([*read.schema, *added])), names, ("n_words", "runs", "collapsed"))


def strongest(runs):
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period. Null without runs."""
    def before(a, b):
        one, two = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(one > two, -1).when(one < two, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.signum(a["period"] - b["period"]).cast("int"))

    return F.get(F.array_sort(runs, before), F.lit(0))
