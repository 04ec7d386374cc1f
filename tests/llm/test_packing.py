import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import tables
from tickerloom.llm import catalog, packing

FILE = public_tokenizers.path(catalog.TOKENIZER)


def expected_ids(texts):
    return [[*x.ids, 1] for x in Tokenizer.from_file(FILE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, length, padded_allowed=False):
    """Sequences without gaps and documents without gaps; sizes of sequences that are not full."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, list(np.frombuffer(r.ids, "<u4")), r.doc_tokens))
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
        sizes.append(at)
    assert padded_allowed or all(n & (n - 1) == 0 for n in sizes)
    return by_doc, sorted(n for n in sizes if n != length)


def joined(pieces):
    out = []
    for start, ids, total in sorted(pieces, key=lambda p: p[0]):
        assert start == len(out)
        out += ids
    assert all(total == len(out) for _, _, total in pieces)
    return out


def test_ids_equal_the_other_library_for_every_character():
    """A vocabulary read here and by its own library: the same ids, whatever the character, and for strings that stand for special tokens."""
    ours, theirs = packing.encoding(packing.read_vocabulary(FILE)), Tokenizer.from_file(FILE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c > 0xF900 and c < 0x20000 or c % 97 == 0)]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}\t{chr(c)}" for c in points] + ["a<|endoftext|>b <|endoftext|>", "", "  \n\n x  ", "it's 12's"]
    assert [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)] == ours.encode_batch(texts, allowed_special="all")


@pytest.mark.parametrize("length,most,parts", [(64, 4, 7), (256, 1, 3), (16, 8, 1), (1, 2, 2)])
def test_every_id_lies_in_one_piece(spark, length, most, parts):
    r = random.Random(length)
    texts = ["".join(r.choice("abcdeth é\n\U0001F600中") for _ in range(r.choice([0, 3, 40, 300]))) for _ in range(120)]
    df = tables.documents(spark, [(i, t, None) for i, t in enumerate(texts)]).repartition(parts)
    by_doc, short = check(packing.pack(df, FILE, length=length, open_windows=most, fan_in=2).collect(), length)
    assert [joined(by_doc[i]) for i in range(len(texts))] == expected_ids(texts)
    assert sum(short) < length  # one window's worth in all, split into powers of two


def test_awkward_rows(spark):
    df = tables.awkward(spark)
    rows = packing.pack(df, FILE).collect()
    assert sum(r.length for r in rows) == sum(map(len, expected_ids([x.text for x in df.select("text").collect()])))
    assert [r.length for r in rows if r.doc_id == 1] == [1] and {r.doc_tokens for r in rows if r.doc_id == 1} == {1}
    assert sum(r.doc_id == 4 and r.start == 0 for r in rows) == 2 and sum(r.doc_id is None and r.start == 0 for r in rows) == 2
    assert packing.pack(tables.empty(spark), FILE).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, FILE, length=1000)


def test_whole_pieces(spark):
    """Without cuts only documents longer than a sequence have more than one piece, and windows may be padded."""
    texts = ["word " * (i % 90) for i in range(200)]
    df = tables.documents(spark, [(i, t, None) for i, t in enumerate(texts)]).repartition(4)
    by_doc, short = check(packing.pack(df, FILE, length=64, cut=False, open_windows=6).collect(), 64, padded_allowed=True)
    for i, ids in enumerate(expected_ids(texts)):
        assert joined(by_doc[i]) == ids and len(by_doc[i]) == -(-len(ids) // 64)
    assert sum(64 - n for n in short) < 0.2 * sum(len(joined(p)) for p in by_doc.values())


def test_windows_stay_bounded_and_best_fit_is_taken():
    p = packing.Packer(10, 2)
    ids = np.arange(10, dtype="<u4")
    for n in (6, 7):
        p.place((n, 0, ids[:n], n))
    p.place((3, 0, ids[:3], 3))  # fits both: the one with less space
    assert [[x[0] for x in w] for w in p.full] == [[7, 3]]
    p.place((8, 0, ids[:8], 8))
    p.place((5, 0, ids[:5], 5))  # fits none: its head fills the fullest, its tail fits elsewhere
    assert [(x[0], x[1], len(x[2])) for x in p.full[1]] == [(8, 0, 8), (5, 0, 2)] and len(p.spaces) <= 2
    left = p.merge_leftovers()
    assert sum(len(x[2]) for w in p.full for x in w) + sum(len(x[2]) for x in left) == 29 and all(sum(len(x[2]) for x in w) == 10 for w in p.full)
    assert [sum(len(x[2]) for x in w) for w in packing.powers_of_two([(0, 0, ids[:7], 7), (1, 0, ids[:4], 4)])] == [8, 2, 1]


def test_registered_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((d.doc_id for d in docs), expected_ids([d.text for d in docs]), strict=True))
    rows = catalog.QUERIES["op11_packing"](spark, folder).collect()
    for r in rows:
        part = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    again = catalog.QUERIES["op11_packing"](spark, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert again.where(F.col("length") < 1).count() == 0
