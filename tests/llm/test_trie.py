import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests import compare
from tickerloom.llm import catalog, trie

TURNS = "conv_id long, turn long, role string, text string, depth string, name int, state string, n string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "s", None) for r in rows], TURNS)


def brute(convs):
    """convs: id to list of (role, text). Node (smallest member, depth) to what it should hold."""
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)
    out = {}

    def below(prefix):
        leaves, saved = (0 if children[prefix] else 1), (len(members[prefix]) - 1) * (len(prefix[-1][1]) if prefix else 0)
        for x in children[prefix]:
            n, s = below(x)
            leaves, saved = leaves + n, saved + s
        ends = sorted(c for c in members[prefix] if len(convs[c]) == len(prefix))
        out[min(members[prefix]), len(prefix)] = (min(members[prefix[:-1]]) if prefix else None, len(members[prefix]), len(children[prefix]), leaves, saved, ends)
        return leaves, saved

    if convs:
        below(())
    return out


def found(result):
    ends = defaultdict(list)
    for x in result.ends.collect():
        ends[x.conv_id, x.depth].append(x.member)
    out = {}
    for x in result.nodes.collect():
        at = (x.conv_id, x.depth)
        assert at not in out and x.n_ends == (len(ends[at]) if at in ends else x.n_ends)
        out[at] = (x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, sorted(ends[at]) if at in ends else [x.conv_id] * x.n_ends if x.n_convs == 1 else [])
    return out


def random_rows(r, convs, longest, words):
    rows, known = [], {}
    for c in convs:
        said = [(r.choice(["user", "assistant"]), "ab é"[:r.randrange(1, 5)] * r.randrange(words)) for _ in range(r.randrange(longest))]
        if known and r.random() < 0.6:
            said = (known[r.choice(list(known))][:r.randrange(longest)] + said)[:longest]
        known[c] = said
        rows += [(c, i, role, text) for i, (role, text) in enumerate(said)]
    return rows, {c: s for c, s in known.items() if s}


@pytest.mark.parametrize("cells", [1 << 12, 1 << 16, 16])
def test_nodes_equal_brute_force(spark, monkeypatch, cells):
    """Also with a sketch so small that nearly every prefix seems shared."""
    monkeypatch.setattr(trie, "SKETCH_CELLS", (cells, max(cells, 16)))
    r = random.Random(cells)
    rows, convs = random_rows(r, r.sample(range(-50, 500), 60), 7, 3)
    r.shuffle(rows)
    assert found(trie.prefix_trie(turns(spark, rows).repartition(5))) == brute(convs)


def test_long_chains_and_hot_conversations(spark):
    """A conversation of 3,000 turns and its copy, prefixes of it that name themselves deeper and deeper, many copies of a short one."""
    long = [("user", f"t{i}") for i in range(3_000)]
    convs = {1000: long, 1001: long} | {900 - i: long[:10 * i + 5] + [("x", str(i))] for i in range(20)} | {i: [("user", "hi"), ("assistant", "")] for i in range(2000, 2400)} | {3000: [("user", "hi")]}
    rows = [(c, i, role, text) for c, said in convs.items() for i, (role, text) in enumerate(said)]
    want = {}
    import sys
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        want = brute(convs)
    finally:
        sys.setrecursionlimit(before)
    assert found(trie.prefix_trie(turns(spark, rows))) == want


def test_awkward_rows(spark):
    rows = [(1, None, None, "x"), (1, 0, "user", None), (2, None, "", "x"), (2, 5, "user", ""), (2, 5, "user", ""), (3, 1, "a", "b" * 100_000), (None, 1, "user", "lost"),
            (4, 1, ":", "1:"), (5, 1, "", ":1:"), (6, 2, "z", "tie"), (6, 2, "a", "tie")]
    got = found(trie.prefix_trie(turns(spark, rows)))
    tie = [t for t in ([("z", "tie"), ("a", "tie")], [("a", "tie"), ("z", "tie")]) if got == brute({
        1: [("", "x"), ("user", "")], 2: [("", "x"), ("user", ""), ("user", "")], 3: [("a", "b" * 100_000)], 4: [(":", "1:")], 5: [("", ":1:")], 6: t})]
    assert tie
    assert found(trie.prefix_trie(turns(spark, rows[:0]))) == {}
    assert found(trie.prefix_trie(turns(spark, [(7, 0, "user", "alone")]))) == brute({7: [("user", "alone")]})


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own[c].append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: (own[c - c % 100] if c - c % 100 in own else [])[:h[c]] + said[h[c]:] for c, said in own.items()}


def test_rebuilt_conversations(spark, folder):
    r = random.Random(9)
    rows, _ = random_rows(r, [*range(0, 40), *range(100, 150), 777, 778, *range(300, 303)], 8, 3)
    df = turns(spark, [x for x in rows if x[0] != 300])  # one lender is absent
    convs = rebuilt([x for x in rows if x[0] != 300])
    assert any(not said for said in convs.values())
    assert found(trie.trie(*trie.with_borrowed_heads(trie.number_turns(df)))) == brute(convs)


def test_digests_of_members(spark):
    ends = spark.createDataFrame([(1, 2, i) for i in range(5000)] + [(1, 3, 7), (-4, 0, 10), (-4, 0, 9)], "conv_id long, depth long, member long").repartition(9)
    trie_pieces, trie.PIECE_CHARS = trie.PIECE_CHARS, 200
    try:
        got = {(x.conv_id, x.depth): x.ends_sha256 for x in trie.ends_digests(ends).collect()}
    finally:
        trie.PIECE_CHARS = trie_pieces
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 2): sha(range(5000)), (1, 3): sha([7]), (-4, 0): sha([9, 10])}


def test_an_estimate_of_one_is_a_proof():
    """No prefix met twice is screened out, whatever the sketch's size; in a roomy one nearly all others are."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    one, two = r.integers(-2 ** 63, 2 ** 63, (2, 3000), dtype=np.int64)
    one[:600], two[:600] = one[600:1200], two[600:1200]
    for cells, most in ((16, 3000), (1 << 16, 1300)):
        batch = pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["p1", "p2"])
        bits = np.zeros(max(trie.ROWS * cells, 1 << 16) // 8, np.uint8)
        for b in trie.merge_blocks(trie.cell_counter(cells)(iter([batch.slice(0, 700), batch.slice(700)]))):
            for block, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bits[block * 8192:(block + 1) * 8192] = np.frombuffer(held, np.uint8)[:len(bits) - block * 8192]
        shared = np.ones(3000, bool)
        for k, c in enumerate(trie.hash_cells(one, two, cells)):
            at = c + k * cells
            shared &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        assert shared[:1200].all() and shared.sum() <= most


def test_registered_query(spark, folder):
    assert compare.differences(catalog.QUERIES["op13_conversation_prefix_trie"](spark, folder), compare.connect(folder), catalog.SQL["op13_conversation_prefix_trie"]) == ""
