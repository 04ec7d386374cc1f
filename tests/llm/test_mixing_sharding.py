import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import tables
from tickerloom.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, share, most):
    """Deals and deals again until no source is above its cap."""
    total = share * sum(sizes.values())
    got, open_ = {s: 0.0 for s in sizes}, set(sizes)
    while open_:
        rest = total - sum(most * sizes[s] for s in sizes if s not in open_)
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > most * sizes[s]}
        if not over:
            return {s: weights[s] * level if s in open_ else most * sizes[s] for s in sizes}
        open_ -= over
    return {s: most * sizes[s] for s in sizes}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_by_hand(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 50]))), r.choice(["b", "a", None, "\u00e9", "c"])) for i in range(300)]
    got = mixing.mix(tables.documents(spark, rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len(WORD.findall(t)) for _, t, x in rows if x == s) for s in order}
    want = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    assert len(got) == len(rows)
    for s in order:
        mine = sorted((x for x in got if x.source == s), key=lambda x: (hashlib.md5(f"mix-1:{x.doc_id}".encode()).hexdigest(), x.doc_id))
        assert all(math.isclose(x.target, want[s], rel_tol=1e-12) and x.source_size == sizes[s] for x in mine)
        quota, before = math.floor(mine[0].target), 0
        for x in mine:
            epochs = quota // sizes[s] if sizes[s] else 0
            assert x.taken == epochs * x.size + max(0, min(x.size, quota - epochs * sizes[s] - before)) <= 2 * x.size
            before += x.size
        assert sum(x.taken for x in mine) == quota


def test_mix_awkward_rows_and_reruns(spark):
    df = tables.awkward(spark)
    one, two = (sorted(map(str, mixing.mix(df).select("doc_id", "size", "taken", "target").collect())) for _ in range(2))
    assert one == two and len(one) == 13
    assert mixing.mix(tables.empty(spark)).count() == 0
    taken = mixing.mix(tables.documents(spark, [(1, None, None), (2, "", None)])).select("size", "target", "taken").collect()
    assert [tuple(x) for x in taken] == [(0, 0.0, 0)] * 2


def test_mixed_documents_repeat_rows(spark):
    df = tables.documents(spark, [(i, "a b c", "s" if i % 2 else "t") for i in range(40)], clash=False)
    mixed = mixing.mix(df).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    out = mixing.mixed_documents(df)
    assert tables.schema_of(out) == tables.schema_of(df)
    assert {x.source: x.n for x in mixed} == {x.source: x["count"] for x in out.groupBy("source").count().collect()}
    assert out.count() == 60


def least_capacity(sizes, shards):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@pytest.mark.parametrize("fetch", [0, 5, 10 ** 6])
def test_smallest_capacity(spark, fetch):
    for sizes, shards in (([5, 1, 1, 1, 9, 2, 2, 30, 1], 4), ([7], 3), ([1] * 50, 8), (random.Random(3).choices(range(1, 400), k=300), 8), ([100, 1, 1, 1], 2)):
        ends, at = [], 0
        for s in sizes:
            at += s
            ends.append((at,))
        cuts = sharding.smallest_capacity(spark.createDataFrame(ends, "end long"), at, max(sizes), shards, fetch=fetch)
        held = [b - a for a, b in zip([0] + cuts, cuts)]
        assert cuts[-1] == at and set(cuts) <= {e for e, in ends} and max(held) == least_capacity(sizes, shards)


def check_shards(rows, shards):
    by = {}
    for x in rows:
        by.setdefault(x.shard, []).append(x)
    assert set(by) <= set(range(shards))
    for s, xs in by.items():
        assert sorted(x.slot for x in xs) == list(range(len(xs)))
    homes, size = {}, {}
    for x in rows:
        homes.setdefault(x.text, set()).add(x.shard)
        size[x.text] = size.get(x.text, 0) + x.size
        assert x.size == len((x.text or "").encode()) + 1 and x.law == "bytes" and x.grown_shard is None
        assert x.text_crc32 == (None if x.text is None else zlib.crc32(x.text.encode()))
    assert all(len(h) == 1 for h in homes.values())
    order = sorted(size, key=lambda t: hashlib.md5(("" if t is None else "=" + t).encode()).hexdigest())
    assert [next(iter(homes[t])) for t in order] == sorted(next(iter(homes[t])) for t in order)
    assert max(sum(x.size for x in xs) for xs in by.values()) == least_capacity([size[t] for t in order], shards)


def test_shards_by_hand(spark):
    r = random.Random(4)
    texts = ["t" * r.randrange(0, 300) + str(i) for i in range(60)]
    rows = [(i, r.choice(texts), "s") for i in range(400)] + [(500 + i, "copy of a hot text", "s") for i in range(200)]
    check_shards(sharding.assign_shards(tables.documents(spark, rows, clash=False), 8).collect(), 8)


def test_shards_awkward(spark):
    got = sharding.assign_shards(tables.awkward(spark), 3)
    assert "Shard" not in got.columns and got.columns.count("size") == 1
    check_shards(got.select("doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect(), 3)
    assert sharding.assign_shards(tables.empty(spark)).count() == 0
