import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tests.llm import tables
from tickerloom.llm import runs


def brute(words, min_length, exponent):
    """Every period, every stretch along which words that far apart are equal; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic_words(r):
    words = [str(r.randrange(r.choice([1, 2, 2, 3, 5, 50]))) for _ in range(r.randrange(0, 130))]
    for _ in range(r.randrange(4)):
        if words:
            a = r.randrange(len(words))
            p = 1 + r.randrange(max(1, (len(words) - a) // 3))
            for i in range(a + p, r.randrange(a, len(words) + 1)):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("min_length,exponent", [(24, 3), (2, 3), (7, 4), (12, 5), (30, 3)])
def test_runs_equal_brute_force(min_length, exponent):
    r = random.Random(min_length * exponent)
    for _ in range(60):
        texts = [periodic_words(r) for _ in range(r.randrange(1, 10))]
        assert runs.runs_of(texts, min_length, exponent) == [brute(w, min_length, exponent) for w in texts]


def test_common_prefixes_are_exact():
    """The suffix order and its common prefixes against plain comparison, over several texts at once."""
    import numpy as np

    r = random.Random(4)
    texts = [[r.randrange(2) for _ in range(r.randrange(20, 60))] for _ in range(4)] + [[1] * 50, [0, 1] * 30]
    tokens = np.unique(np.concatenate([np.array(t) + 10 * i for i, t in enumerate(texts)]), return_inverse=True)[1]
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    chosen = runs.repeated_positions(tokens, ends, 4)
    order, common = runs.suffix_order(tokens, ends, chosen, 4)
    suffix = lambda i: tokens[i:ends[i]].tolist()
    assert order.tolist() == sorted(chosen.tolist(), key=suffix)
    for a, b, n in zip(order[:-1], order[1:], common[1:], strict=True):
        x, y = suffix(a), suffix(b)
        assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_whole_table_with_awkward_rows(spark):
    r = random.Random(5)
    texts = [" ".join(periodic_words(r)) for _ in range(150)]
    df = tables.documents(spark, [(i, t, None) for i, t in enumerate(texts)]).repartition(3).unionByName(tables.awkward(spark))
    out = runs.periodic_runs(df, min_length=9)
    assert out.columns == df.columns + ["n_words", "runs", "collapsed"]
    rows = out.select("doc_id", "text", "n_words", "runs", "collapsed").collect()
    assert len(rows) == len(texts) + 13
    for x in rows:
        words = (x.text or "").encode().split()
        assert x.n_words == len(words)
        if len(words) < 1000:
            want = brute(words, 9, 3)
            dropped = {i for s, n, q in want for i in range(s + q, s + n)}
            assert [tuple(y) for y in x.runs] == want and x.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in dropped)
        else:  # 60,000 words of period 977
            assert [tuple(y) for y in x.runs] == [(0, 60_000, 977)] and len(x.collapsed.split()) == 977
    assert runs.periodic_runs(tables.empty(spark)).collect() == []
    clash = runs.periodic_runs(tables.documents(spark, [(1, "a " * 30, None)]).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x")))
    assert [(x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in clash.collect()] == [(30, [(0, 30, 1)], "a")]
    for bad in ({"min_exponent": 2}, {"min_length": 1}):
        with pytest.raises(ValueError):
            runs.periodic_runs(df, **bad)


def test_strongest_is_compared_exactly(spark):
    rows = [(1, [(0, 30, 10), (40, 31, 10), (90, 62, 20)]), (2, [(5, 24, 4), (0, 24, 4), (0, 48, 8)]), (3, []), (4, [(0, 3 * 10 ** 9, 10 ** 9), (7, 3 * 10 ** 9 + 1, 10 ** 9)])]
    df = spark.createDataFrame(rows, f"id int, runs {runs.RUN}")
    got = {x.id: x.best and tuple(x.best) for x in df.select("id", runs.strongest(F.col("runs")).alias("best")).collect()}
    assert got == {1: (40, 31, 10), 2: (0, 24, 4), 3: None, 4: (7, 3 * 10 ** 9 + 1, 10 ** 9)}


def test_many_occurrences_cost_little():
    """One word alone, and a phrase behind many different words: neither lists pairs by the square."""
    tracemalloc.start()
    phrase = [f"p{i}" for i in range(20)]
    spread = [w for i in range(600) for w in [f"x{i}", *phrase]]
    assert runs.runs_of([["a"] * 20_000, spread, phrase * 500], 24, 3) == [[(0, 20_000, 1)], [], [(0, 10_000, 20)]]
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
