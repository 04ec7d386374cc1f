"""Substring dedup by paragraph MinHash banding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import seal, sealed_column, written
from tickerloom.llm.components import components
from tickerloom.llm.filters import filter_bits, held_digests, may_hold

SHINGLE = 5
#: Bands and rows: of paragraphs with a Jaccard similarity of 0.8, 99.1 % share a band, of one of 0.3 7 %.
BANDS, ROWS = 9, 4
#: Fewer words make no other paragraph of that similarity: one shingle more or less is over a fifth.
LEAST_BANDED = SHINGLE + 3
SIMILARITY = 0.8
#: Of a band of no more different texts all pairs are compared at once.
FEW = 8
#: Members of a larger band that each of its members is compared with.
REPRESENTATIVES = 3
#: Bits of a text's sketch, in two longs.
SKETCH = 128
#: All pairs left are compared when they are no more than so many times the rows they are made of.
ALL_LEFT = 20
#: Paragraphs of more words are also compared in parts, cut where the text itself says.
LONG = 40
#: A part begins where the hash of three words is the least of so many on either side.
REACH = 5
#: Words of a repeated stretch worth reporting.
LEAST_SPAN = 15
#: Words of a part of a run of one word.
SAME = 16
KNOWN = 200_000
TOGETHER = 20_000
#: Hashes made at once; shingles that need more are hashed for one multiplier after another, about IN_CACHE of them at a time.
AT_ONCE = 100_000
IN_CACHE = 8_000
#: Bytes of text cut into units at once; a longer text is taken by itself.
PIECE = 1 << 20
#: Shingles that a task keeps of the texts it compares (8 bytes each).
KEPT_SHINGLES = 4_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)
MULTIPLIERS, SKETCHERS = (np.random.default_rng(seed).integers(1, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed, n in ((7, BANDS * ROWS), (8, SKETCH)))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP
    return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = max(0, len(words) - length + 1)
    found = np.zeros(n, np.uint64)
    for j in range(length):
        found = found * STEP + words[j:j + n]
    return stirred(found)


def places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of runs of those lengths, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(lengths.sum()) + np.repeat(starts - (ends - lengths), lengths)


def part_starts(three: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, word): where the parts of long stretches of words begin, in order. ``three`` has the hash of three words from each word of
    the batch on. Whether a word begins a part depends on the words around it alone, so a passage is cut alike wherever it stands."""
    within = lengths - 2
    first = np.cumsum(within) - within + REACH * np.arange(1, len(starts) + 1)  # stretches lie apart by REACH places that are never the least
    hashes = np.full(within.sum() + REACH * (len(starts) + 1), LARGEST)
    hashes[places(first, within)] = three[places(starts, within)]
    n = len(hashes) - 2 * REACH
    least = hashes[:n + REACH + 1].copy()  # of REACH hashes from a place on
    for d in range(1, REACH):
        np.minimum(least, hashes[d:d + len(least)], out=least)
    middle = hashes[REACH:REACH + n]
    cuts = [first, np.nonzero((middle < least[:n]) & (middle <= least[REACH + 1:]))[0] + REACH]
    same = (hashes[1:] == hashes[:-1]) & (hashes[1:] != LARGEST)
    if same.any():  # one word again and again: parts of equal length from where it begins
        edges = np.diff(np.concatenate(([0], same.astype(np.int8), [0])))
        cuts += [np.arange(a, b, SAME) for a, b in zip(np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0])]
    found = np.unique(np.concatenate(cuts))
    stretch = np.searchsorted(first, found, "right") - 1
    return stretch, found - first[stretch] + starts[stretch]


def parts(three: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, word, words) of the parts of SHINGLE words or more."""
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    stretch, word = part_starts(three, starts, lengths)
    last = np.append(stretch[1:] != stretch[:-1], True)
    long = np.where(last, (starts + lengths)[stretch], np.append(word[1:], 0)) - word
    whole = long >= SHINGLE
    return stretch[whole], word[whole], long[whole]


def minima(shingles: np.ndarray, starts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least hashes [paragraph, multiplier] of consecutive runs of shingles."""
    if len(shingles) * len(multipliers) <= AT_ONCE:  # one pass over a small matrix
        return np.minimum.reduceat(stirred(multipliers[:, None] * shingles[None, :]), starts, axis=1).T
    found = np.empty((len(starts), len(multipliers)), np.uint64)
    block = starts // IN_CACHE
    edges = np.concatenate(([0], np.nonzero(block[1:] != block[:-1])[0] + 1, [len(starts)]))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        a, b = starts[i], starts[j] if j < len(starts) else len(shingles)
        some, at, h, shifted = shingles[a:b], starts[i:j] - a, np.empty(b - a, np.uint64), np.empty(b - a, np.uint64)
        for k, m in enumerate(multipliers):  # as ``stirred``, in place
            np.multiply(some, m, out=h)
            np.bitwise_xor(h, np.right_shift(h, np.uint64(31), out=shifted), out=h)
            np.multiply(h, STEP, out=h)
            np.bitwise_xor(h, np.right_shift(h, np.uint64(29), out=shifted), out=h)
            found[i:j, k] = np.minimum.reduceat(h, at)
    return found


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys [paragraph, band] of consecutive runs of shingles."""
    least = minima(shingles, starts, MULTIPLIERS)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(starts), 1))
    for j in range(ROWS):
        keys = keys * STEP + least[:, j::ROWS]
    return stirred(keys)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows with about so many bytes of text each."""
    begin = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.nonzero(begin[1:] != begin[:-1])[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def list_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, word, words, digest, bands, text) of the paragraphs of texts, of the parts of long ones, and of the parts
    of texts of more than LONG words without regard to their lines.

    A paragraph is a line of at least SHINGLE words, A to Z in lower case; ``word`` is the place of its first word in the text. Only whole
    paragraphs of LEAST_BANDED words have bands and text. Words, hashes and cuts are made for many texts at once."""
    for batch in (piece for whole in batches for piece in slices(whole, 2, PIECE)):
        lines = pc.split_pattern(pc.ascii_lower(pc.fill_null(batch.column(2), "")), "\n")
        split = pc.ascii_split_whitespace(lines.flatten())
        words = split.flatten()
        real = pc.greater(pc.binary_length(words), 0)  # blanks at the ends of a line leave empty words
        line_words = np.bincount(pc.list_parent_indices(split).filter(real).to_numpy(), minlength=len(split))
        words = words.filter(real).cast(pa.binary())
        line_at = np.cumsum(line_words) - line_words
        of = pc.list_parent_indices(lines).to_numpy()
        text_words = np.bincount(of, line_words, batch.num_rows).astype(np.int64)
        text_at = np.cumsum(text_words) - text_words

        coded = words.dictionary_encode()
        codes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
        three = rolling(codes, 3)
        paragraph, long = np.nonzero(line_words >= SHINGLE)[0], np.nonzero(line_words > LONG)[0]
        stretch, part, part_words = parts(three, line_at[long], line_words[long])
        cut = part_words < line_words[long][stretch]  # a paragraph of one part is listed once
        within, part, part_words = of[long][stretch][cut], part[cut], part_words[cut]
        at, length = np.concatenate((line_at[paragraph], part)), np.concatenate((line_words[paragraph], part_words))
        long = np.nonzero(text_words > LONG)[0]  # the whole text as one stream of words, whatever its lines
        stretch, part, part_words = parts(three, text_at[long], text_words[long])
        new = ~np.isin(part << 32 | part_words, at << 32 | length)
        row = np.concatenate((of[paragraph], within, long[stretch][new]))
        at, length = np.concatenate((at, part[new])), np.concatenate((length, part_words[new]))

        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py()
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        begins = np.append(0, ends)
        digests = np.fromiter((xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(begins[at].tolist(), (begins[at + length] - 1).tolist())), np.uint64, len(at))

        banded = np.nonzero(line_words[paragraph] >= LEAST_BANDED)[0]  # paragraphs are the first units
        lengths = length[banded] - SHINGLE + 1
        keys = signatures(rolling(codes, SHINGLE)[places(at[banded], lengths)], np.cumsum(lengths) - lengths) if len(banded) else np.zeros((0, BANDS), np.uint64)
        texts = pc.binary_join(pa.ListArray.from_arrays(np.append(line_at, len(words)).astype(np.int32), words), b" ").cast(pa.string())
        order = np.argsort(row, kind="stable")
        has = np.full(len(row), -1)
        has[banded] = np.arange(len(banded))
        has = has[order]
        of_line = np.zeros(len(row), np.int64)
        of_line[banded] = paragraph[banded]
        bands = pa.ListArray.from_arrays(np.append(0, np.cumsum((has >= 0) * BANDS)).astype(np.int32), keys[has[has >= 0]].view(np.int64).ravel(), mask=pa.array(has < 0))
        taken = pa.array(row[order])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), batch.column(1).take(taken), pa.array((at - text_at[row])[order]), pa.array(length[order]),
             pa.array((digests ^ np.uint64(1 << 63)).view(np.int64)[order]), bands, texts.take(pa.array(of_line[order], mask=has < 0))],
            names=["row", "id", "word", "words", "digest", "bands", "text"])


def shingles_of(text: str, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a paragraph's text, as sorted hashes of 64 bits."""
    words = text.encode("utf-8", "replace").split(b" ")
    return np.unique(rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), SHINGLE))


def alike(similarity: float):
    @F.pandas_udf("boolean")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes, kept, held = WordHashes(), {}, 0
        for one, other in batches:
            found = []
            for pair in zip(one, other):
                if len(hashes) > KNOWN:
                    hashes.clear()
                if held > KEPT_SHINGLES:
                    kept, held = {}, 0
                sets = []
                for text in pair:
                    if text not in kept:
                        kept[text] = shingles_of(text, hashes)
                        held += len(kept[text])
                    sets.append(kept[text])
                s, t = sets
                common = len(np.intersect1d(s, t, assume_unique=True))
                found.append(common >= similarity * (len(s) + len(t) - common))
            yield pd.Series(found, dtype="bool")

    return compared


def held_keys(held: np.ndarray):
    """(key, digest) of the bands of rows (digest, bands) whose key the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).flatten()
            digests = batch.column(0).take(pc.list_parent_indices(batch.column(1)))
            yield pa.RecordBatch.from_arrays([keys, digests], names=["key", "digest"]).filter(pa.array(may_hold(held, keys.to_numpy().view(np.uint64))))

    return run


def shared_keys(units: DataFrame) -> DataFrame:
    """(key, digest): the bands that several digests have. All bands are shuffled once, to find their first and last digest; what has no
    partner is then held back by a bounded filter."""
    banded = units.where("bands is not null").select("digest", "bands")
    ends = banded.select("digest", F.explode("bands").alias("key")).groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    keys = written(ends.where("low < high").select("key"))
    held = held_digests(keys.select(F.col("key").alias("digest")), filter_bits(keys.count()))
    return written(banded.mapInArrow(held_keys(held), "key long, digest long").join(keys, "key", "left_semi").distinct())


def held_shapes(held: np.ndarray):
    """(digest, size, one, two) of the texts (digest, text) that the filter may hold: the number of distinct shingles, and a bit of each of
    SKETCH minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), {}
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(held, batch.column(0).to_numpy().view(np.uint64))))
            digests = batch.column(0).to_pylist()
            rows = []
            for digest, text in zip(digests, batch.column(1)):
                if digest not in known:
                    if len(hashes) > KNOWN:
                        hashes.clear()
                    if len(known) > TOGETHER:
                        known.clear()
                    shingles = shingles_of(text.as_py(), hashes)
                    bits = minima(shingles, np.zeros(1, np.int64), SKETCHERS)[0] & np.uint64(1)
                    known[digest] = (len(shingles), *np.packbits(bits.astype(np.uint8)).view(np.int64).tolist())
                rows.append(known[digest])
            size, one, two = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                                             names=["digest", "size", "one", "two"])

    return run


def shapes_of(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, size, one, two) of the wanted digests (unique), once each; no text is shuffled."""
    held = held_digests(wanted, filter_bits(wanted.count()))
    shapes = units.where("text is not null").select("digest", "text").mapInArrow(held_shapes(held), "digest long, size int, one long, two long")
    return written(shapes.dropDuplicates(["digest"]).join(wanted, "digest", "left_semi"))


def may_be_alike(a: str, b: str, similarity: float) -> Column:
    """Whether two shapes allow that similarity: by their sizes, and by their sketches with a margin of six deviations, so that of ten million
    pairs of that similarity about one is lost."""
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("one", "two")), F.lit(0))
    expected = SKETCH * (1 - similarity) / 2
    most = math.ceil(expected + 6 * math.sqrt(expected * (1 + similarity) / 2) + 1)
    sizes = F.least(f"{a}.size", f"{b}.size") >= similarity * F.greatest(f"{a}.size", f"{b}.size") - 1e-6
    return (F.col(f"{a}.root") != F.col(f"{b}.root")) & sizes & (differ <= most)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b")).distinct()


def representative_pairs(met: DataFrame, similarity: float, salt: int = 0) -> DataFrame:
    """(a, b): each member of (key, digest, root, size, one, two) with those of its key's representatives, the first of some orders, that it
    may be like."""
    member = F.struct("digest", "root", "size", "one", "two")
    marks = met.groupBy("key").agg(F.array(*[
        F.min(F.struct(F.xxhash64("digest", F.lit(salt * REPRESENTATIVES + i)).alias("o"), member.alias("m")))["m"] for i in range(REPRESENTATIVES)]).alias("marks"))
    both = met.select("key", member.alias("x")).join(marks, "key").select("x", F.explode(F.array_distinct("marks")).alias("y"))
    return ordered_pairs(both.where(may_be_alike("x", "y", similarity)))


def listed_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the members of a key of (key, digest, root, size, one, two) that may be like each other."""
    member = F.struct("digest", "root", "size", "one", "two")
    one, other = met.select("key", member.alias("x")), met.select(F.col("key").alias("_key"), member.alias("y"))
    return ordered_pairs(one.join(other, (F.col("key") == F.col("_key")) & (F.col("x.root") < F.col("y.root")) & may_be_alike("x", "y", similarity)))


def held_texts(held: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held, batch.column(0).to_numpy().view(np.uint64))))

    return run


def texts_of(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, text) of the wanted digests (unique); a bounded filter keeps most other texts out of the shuffle."""
    held = held_digests(wanted, filter_bits(wanted.count()))
    likely = units.where("text is not null").select("digest", "text").mapInArrow(held_texts(held), "digest long, text string")
    return likely.join(wanted, "digest", "left_semi").dropDuplicates(["digest"])


def verified(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose word shingles, as hashes of 64 bits, have at least that Jaccard similarity."""
    texts = texts_of(units, written(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()))
    both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("_a")), "a").join(texts.select(F.col("digest").alias("b"), F.col("text").alias("_b")), "b")
    return written(both.where(alike(similarity)("_a", "_b")).select("a", "b"))


def joined(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of (key, digest, root, ...) with their roots after those links; only roots that a link joins enter the components."""
    of = rooted.select("digest", "root").distinct()
    edges = links.join(of.select(F.col("digest").alias("a"), F.col("root").alias("_a")), "a").join(of.select(F.col("digest").alias("b"), F.col("root").alias("_b")), "b")
    moved = components(edges.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return rooted.join(moved, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")


def still_open(rooted: DataFrame) -> DataFrame:
    """The rows of (key, digest, root, ...) whose key has members of several components."""
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return written(rooted.join(several, "key", "left_semi"))


def list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, size, shingle) of texts (digest, text): the distinct shingles of each and their number."""
    hashes = WordHashes()
    for batch in batches:
        row, sizes, found = [], [], [np.zeros(0, np.uint64)]
        for r, text in enumerate(batch.column(1).to_pylist()):
            if len(hashes) > KNOWN:
                hashes.clear()
            found.append(shingles_of(text, hashes))
            row.append(r)
            sizes.append(len(found[-1]))
        each = np.repeat(np.array(row, np.int64), sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(each)), pa.array(np.repeat(np.array(sizes, np.int32), sizes)), pa.array(np.concatenate(found).view(np.int64))],
                                         names=["digest", "size", "shingle"])


def rare_shingles(texts: DataFrame, similarity: float) -> DataFrame:
    """(key, digest, size): the rarest shingles of each text, so many that two texts of that similarity have one of them in common.

    The shingles of all texts stand in one order, rarest first. If two texts share a share of ``similarity`` of each one's shingles, they
    share one of the first size - similarity * size + 1 of each. What many have in common is thereby left out."""
    listed = written(texts.mapInArrow(list_shingles, "digest long, size int, shingle long"))
    counts = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy("digest").orderBy("n", "shingle"))
    first = listed.join(counts, "shingle").withColumn("at", at).where((F.col("n") > 1) & (F.col("at") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-6) + 1))
    return written(first.select(F.col("shingle").alias("key"), "digest", "size"))


def rest_links(open_rows: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """(a, b): what is alike among the digests of (digest, root, size, one, two), unless their roots are the same, enough to connect it.

    Members that have a rare shingle in common and are not linked yet, directly or not, are compared: with representatives of the shingle
    and, as long as that links something, with others; then what is left, each pair by size and sketch before anything is listed."""
    keyed = rare_shingles(texts_of(units, written(open_rows.select("digest"))), similarity)
    left = still_open(keyed.select("key", "digest").join(open_rows, "digest"))
    salt, links = 0, []
    while True:
        by_root = left.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("s")).groupBy("key").agg(F.sum("s").alias("n"), F.sum(F.col("s") * F.col("s")).alias("same"))
        n, pairs = by_root.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not n:
            break
        every = pairs <= ALL_LEFT * n or (links and links[-1].isEmpty())
        salt += 1
        links.append(verified(written(listed_pairs(left, similarity) if every else representative_pairs(left, similarity, salt)), units, similarity))
        if every:
            break
        left = still_open(joined(left, links[-1]))
    return reduce(DataFrame.unionByName, links, units.sparkSession.createDataFrame([], "a long, b long") if not links else links.pop(0))


def near_links(units: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of different texts (digest, bands, text) whose word shingles have at least that Jaccard similarity, enough to connect
    all such pairs that share a band.

    Equal texts are folded first. Of a band of few all pairs are compared, of a larger one each member with representatives. If that does
    not connect the whole band, its members are compared by their rare shingles, which leaves out no pair of that similarity. Sizes and
    sketches decide which pairs' texts are looked at."""
    keys = shared_keys(units)
    shapes = shapes_of(units, written(keys.select("digest").distinct()))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = written(keys.join(counts, "key").join(shapes, "digest").withColumn("root", F.col("digest")))
    few, large = met.where(F.col("n") <= FEW), met.where(F.col("n") > FEW)
    links = verified(written(listed_pairs(few, similarity).unionByName(representative_pairs(large, similarity)).distinct()), units, similarity)
    if large.isEmpty():
        return links
    roots = components(links).select(F.col("node").alias("digest"), F.col("root").alias("_root"))
    left = still_open(large.join(roots, "digest", "left").withColumn("root", F.coalesce("_root", "root")).select("key", "digest", "root", "size", "one", "two"))
    open_rows = written(left.drop("key").distinct())
    return links if open_rows.isEmpty() else written(links.unionByName(rest_links(open_rows, units, similarity)).distinct())


def held_by(held: np.ndarray):
    """Rows (row, id, word, words, digest) whose digest the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held, batch.column(4).to_numpy().view(np.uint64))))

    return run


def repeated(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, word, words, class_id, kept): every paragraph, and part of a long one or of the text, that some other document has too.

    Paragraphs are lines of five words or more; those over ``LONG`` words are also compared in parts cut by their own content, so that a passage
    inside different paragraphs is found, and so are texts of more words as a whole, so that a passage is found whatever its line ends. Equal ones form a class by digest; MinHash bands bring near ones together, exact Jaccard similarity of
    word shingles links them, components of links join their classes. Of a class that spans several rows of ``docs`` the first occurrence (by
    id, null last, row and place) is kept; ``kept`` is false for what a dedup removes. ``class_id`` is the same within a class; word and words say
    where in the text, counted in words. Matches within one document alone are not listed.

    Null, empty and shorter texts have no paragraphs. Repeated rows count as documents of their own, with the same id. Other columns are
    ignored. An empty table gives no rows."""
    rows, names = seal(docs)
    ident, text = F.col(sealed_column(names, id_column)), F.col(sealed_column(names, text_column))
    kind = rows.select(ident).schema[0].dataType.simpleString()
    units = written(rows.select(F.monotonically_increasing_id(), ident, text).mapInArrow(
        list_units, f"row long, id {kind}, word long, words long, digest long, bands array<long>, text string"))
    # most digests occur in one row only; those go before anything else is joined
    several = units.groupBy("digest").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("digest")
    roots = written(components(near_links(units, similarity)).select(F.col("node").alias("digest"), F.col("root").alias("class_id")))
    classes = written(several.join(roots, "digest", "full_outer").select("digest", F.coalesce("class_id", "digest").alias("class_id")))
    held = held_digests(classes, filter_bits(classes.count()))
    kept = units.select("row", "id", "word", "words", "digest").mapInArrow(held_by(held), f"row long, id {kind}, word long, words long, digest long")
    found = written(kept.join(classes, "digest").drop("digest"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "word")
    firsts = found.groupBy("class_id").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min(place).alias("first")).where("low < high")
    listed = found.join(firsts.select("class_id", "first"), "class_id")
    return listed.select("row", "id", "word", "words", "class_id", ((F.col("row") == F.col("first.row")) & (F.col("word") == F.col("first.word"))).alias("kept"))


def spans(units: DataFrame, least_words: int = LEAST_SPAN) -> DataFrame:
    """(row, id, word, words, class_id, kept): the stretches that the rows of ``repeated`` make up, of ``least_words`` words or more.

    Units of a row that overlap belong together; one that only follows another does if some other row has these two classes side by side
    as well, so that phrases which many documents have, each in its own place, make no passage. What a dedup removes and what it keeps are
    stretches of their own. A stretch has the class of its longest unit, of several the smallest. Of a passage inside other text whole parts
    count: one of 51 words shows 15 or more of them 96 times in a hundred, one of 60 words 99 times, and a whole paragraph all its words. No units give no rows."""
    side = Window.partitionBy("row", "kept").orderBy("word", "words", "class_id")
    last = F.max(F.struct((F.col("word") + F.col("words")).alias("end"), F.col("class_id").alias("class"))).over(side.rowsBetween(Window.unboundedPreceding, -1))
    placed = written(units.withColumn("_last", last))
    follows = F.col("word") == F.col("_last.end")
    pair = F.xxhash64("_last.class", "class_id")
    shared = placed.where(follows).select(pair.alias("_pair"), "row").groupBy("_pair").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high")
    alone = F.xxhash64("row", "word", "words")  # looked up in vain or not heeded: rows that follow nothing are many, and so dealt to all tasks
    beside = placed.withColumn("_pair", F.when(follows, pair).otherwise(alone)).join(shared.select("_pair", F.lit(True).alias("_both")), "_pair", "left")
    begins = F.when(F.col("_last").isNull() | (F.col("word") > F.col("_last.end")) | (follows & F.col("_both").isNull()), 1).otherwise(0)
    longest = F.max_by("class_id", F.struct("words", (-F.col("class_id")).alias("order"))).alias("class_id")
    found = beside.withColumn("_span", F.sum(begins).over(side)).groupBy("row", "kept", "_span").agg(
        F.first("id").alias("id"), F.min("word").alias("word"), (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("words"), longest)
    return found.where(F.col("words") >= least_words).select("row", "id", "word", "words", "class_id", "kept")
