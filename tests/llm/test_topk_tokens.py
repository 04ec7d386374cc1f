import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import tables
from tickerloom.llm import tokens, topk

VECTORS = "vec_id long, embedding array<double>, label int, score string, row string"


def brute(rows, k):
    whole = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((n, i, [math.floor(256 * x) for x in v]))
    out = []
    for n, i, q in whole:
        if i is None or i % 50:
            continue
        found = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(q, c)))), j is None, j or 0) for m, j, c in whole if m != n and len(c) == len(q))
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [1, 3, 1000])
def test_top_k_by_hand(spark, tile):
    r = random.Random(7)
    rows = [(i, [r.choice([-0.5, -0.1, 0.0, 0.1, 0.3]) for _ in range(4)]) for i in range(260)]
    rows += [(50, [0.5] * 4), (50, [0.5] * 4), (None, [0.5] * 4), (300, None), (350, [1.0, None, 0.0, 0.0]), (400, [math.nan] * 4), (450, [math.inf, 0.0, 0.0, 0.0]), (500, [0.1, 0.2]), (501, [0.3, 0.2]), (550, [])]
    df = spark.createDataFrame([(i, v, None, "s", "r") for i, v in rows], VECTORS).repartition(5)
    got = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_tile=tile).collect()]
    assert sorted(got, key=str) == brute(rows, 5)


def test_top_k_large_numbers_and_empty(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e12, -7.5]), (2, [-1e12, 1.0]), (3, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, None, "s", "r") for i, v in rows], VECTORS)
    assert sorted((tuple(x) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=str) == brute(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_products_stay_exact():
    a, b = np.array([[2.0 ** 40, 1.0]]), np.array([[2.0 ** 20, 1.0]])
    assert int(topk.products(a, b)[0, 0]) == 2 ** 60 + 1


def segmented(word, pieces, unknown):
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        n = len(word[e - 1].encode())
        best[e] = (best[e - 1][0] + unknown * n, best[e - 1][1] + n)
        for b in range(e - 1, -1, -1):
            if word[b:e] in pieces and best[b][0] + pieces[word[b:e]] > best[e][0]:
                best[e] = (best[b][0] + pieces[word[b:e]], best[b][1] + 1)
    return best[-1][1]


def test_counts_equal_a_plain_segmentation(spark):
    pieces = tokens.read_pieces(tokens.VOCABULARY)
    r = random.Random(8)
    texts = ["".join(r.choice("abcdeth \u00e9\n\U0001F600\u4e2d") for _ in range(r.randrange(0, 200))) for _ in range(60)]
    df = tables.documents(spark, [(i, t, None) for i, t in enumerate(texts)]).unionByName(tables.awkward(spark))
    unknown = min(pieces.values()) - 10
    for x in tokens.token_counts(df).select("text", "n_tokens").collect():
        words = (x.text or "").encode().split()
        if len(words) < 1000 and all(len(w) < 1000 for w in words):
            assert x.n_tokens == sum(segmented(tokens.SPACE + w.decode(), pieces, unknown) for w in words)
        else:
            assert x.n_tokens >= len(words)
    assert tokens.token_counts(tables.empty(spark)).count() == 0


def test_shared_prefixes_are_computed_once():
    looked = []

    class Spy(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    counter = tokens.Counter({"\u2581a": -1.0, "b": -1.0, "\u2581ab": -1.5, "c": -2.0, "d": -2.0})
    counter.pieces = Spy(counter.pieces)
    counter.learn({b"abbbc", b"abbbd", b"abbb"})
    assert dict(counter) == {b"abbb": 3, b"abbbc": 4, b"abbbd": 4} and looked.count("\u2581ab") == 1
