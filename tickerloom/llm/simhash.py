"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import seal, sealed_column, unseal, written
from tickerloom.llm.components import components
from tickerloom.llm.paragraphs import LEAST_BANDED, SHINGLE, near_links, rolling, signatures

BITS = 64
SEED = 42
BLOCK = 1 << 15
#: Distinct words a task remembers.
KNOWN = 200_000


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of the text's word shingles as an unsigned number; 0 without words.

    A to Z are lower-cased, a word ends at a blank or at tab to carriage return, shingles are joined by blanks, counted as often as they
    occur and hashed by XXH64; a bit is set if it is set in over half the hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[-n:].tolist()
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):  # bounds the memory of a very long text
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:min(n, at + BLOCK)].tolist(), last[at:at + BLOCK])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(words: int):
    """A column function: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64) if len(texts) else [], dtype="int64")

    return made


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, fp, bands, text) of texts (fp, text): each as one paragraph, its words in lower case joined by blanks, with the digest and
    the band keys of that. Texts too short to differ a little are left out."""
    hashes = WordHashes()
    for batch in batches:
        row, digests, bands, texts = [], [], [], []
        for r, text in enumerate(batch.column(1).to_pylist()):
            if len(hashes) > KNOWN:
                hashes.clear()
            found = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if len(found) < LEAST_BANDED:
                continue
            shingles = rolling(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)), SHINGLE)
            joined = b" ".join(found)
            row.append(r)
            digests.append(xxhash.xxh64_intdigest(joined) - (1 << 63))
            bands.append(signatures(shingles, np.zeros(1, np.int64))[0].view(np.int64).tolist())
            texts.append(joined.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(bands, pa.list_(pa.int64())), pa.array(texts, pa.string())],
                                         names=["digest", "fp", "bands", "text"])


def similar_links(hashed: DataFrame, text: Column, similarity: float) -> DataFrame:
    """(a, b): fingerprints of texts whose sets of five-word shingles have that Jaccard similarity or more, found by MinHash bands and
    judged exactly, for pairs of texts that a few edits set further apart than the radius.

    Every different text takes part for itself; only the pairs found are put down to fingerprints."""
    units = written(hashed.select("_fp", text).mapInArrow(whole_texts, "digest long, fp long, bands array<long>, text string"))
    pairs = near_links(units, similarity)
    prints = units.select("digest", "fp").join(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    side = lambda c: prints.select(F.col("digest").alias(c), F.col("fp").alias(f"_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()


def covering_masks(radius: int) -> list[int]:
    """Masks of kept bits such that any ``radius`` positions lie outside one of them.

    Each position has a nonzero vector of radius + 1 bits; mask v keeps the positions whose vector has odd parity with v. For any
    ``radius`` positions some nonzero v is orthogonal to all their vectors, so that mask keeps none of them."""
    size = (1 << (radius + 1)) - 1
    vectors = [i % size + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vectors[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column ``fp``) at ``radius`` (1 or 2) or fewer differing bits, enough to
    connect whatever is connected by such pairs.

    Covering masks give 2^(radius + 1) - 1 tables; every pair within the radius shares a key of some table. A fingerprint that is alone
    under all its keys has no partner. The others are joined by what lies between: two fingerprints differ in at most two bits exactly if
    one flip (or none) of each gives the same number, and a pair's differing bits are bits its common mask leaves free. So each
    candidate is listed under its flips of free bits; everything listed under one number is within the radius of each other, at
    most 65 fingerprints however large a bucket is, and hangs on the smallest. No pairs of a bucket are ever listed."""
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    masks = covering_masks(radius)
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"), F.lit(signed(~m & (1 << BITS) - 1)).alias("free"))
        for t, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key", "k.free")
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    candidates = keyed.join(shared, ["t", "key"]).groupBy("fp").agg(F.bit_or("free").alias("free"))
    singles = F.array(*[F.lit(signed(1 << i)) for i in range(BITS)])
    flips = F.transform(F.filter(singles, lambda b: F.col("free").bitwiseAND(b) != 0), lambda b: F.col("fp").bitwiseXOR(b))
    if radius == 1:  # two fingerprints differ in one bit exactly if both list the same pair of a number and its flip
        listed = candidates.select("fp", F.explode(flips).alias("z")).select("fp", F.least("fp", "z").alias("a"), F.greatest("fp", "z").alias("b"))
        return listed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    listed = candidates.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("z"))
    balls = listed.groupBy("z").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    return balls.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_column: str = "doc_id", text_column: str = "text",
                    similarity: float | None = None) -> DataFrame:
    """Adds fingerprint (16 hexadecimal digits), component_id (the smallest id reachable over links), component_print (the
    component's smallest fingerprint as a signed number, in the same form) and stays.

    Copies are first folded into one fingerprint each, so a group of equal texts costs one row in every later step. ``stays`` is true for
    the rows that have the smallest id of their component. Texts without words, null ones included, have fingerprint zero and are linked like
    others. Null ids are never a component's id unless all are null; then component_id is null and those rows stay. With ``similarity``
    texts whose five-word shingles are that alike are linked too, however many bits differ. Repeated rows are rows of their own. Input columns named like an added one are replaced. An empty table gives no rows."""
    rows, names = seal(docs)
    ident = F.col(sealed_column(names, id_column))
    hashed = written(rows.withColumn("_fp", fingerprints(words)(F.col(sealed_column(names, text_column)))))
    prints = written(hashed.groupBy(F.col("_fp").alias("fp")).agg(F.min(ident).alias("least")))
    edges = links(prints.select("fp"), radius)
    if similarity is not None:
        edges = edges.unionByName(similar_links(hashed, F.col(sealed_column(names, text_column)), similarity))
    roots = components(edges)
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    digits = {c: F.lpad(F.lower(F.hex(x)), 16, "0") for c, x in (("fingerprint", "_fp"), ("component_print", "root"))}
    joined = hashed.join(named, "_fp").withColumns(digits | {"stays": ident.eqNullSafe(F.col("component_id"))})
    return unseal(joined, names, ("fingerprint", "component_id", "component_print", "stays"))


def deduplicated(docs: DataFrame, words: int = 3, radius: int = 2, id_column: str = "doc_id", text_column: str = "text",
                 similarity: float | None = None) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with the smallest id, of repeated (or only null) ids the one
    with the smallest text digest."""
    rows, names = seal(near_duplicates(docs, words, radius, id_column, text_column, similarity).where("stays"))
    text, component = F.col(sealed_column(names, text_column)), F.col(sealed_column(names, "component_print"))
    first = F.row_number().over(Window.partitionBy(component).orderBy(F.md5(text.cast("binary"))))
    return unseal(rows.withColumn("_first", first).where("_first = 1"), names).select(*docs.columns)
