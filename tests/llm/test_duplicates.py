import itertools
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import functions as F

from tests.llm import tables
from tickerloom.llm import components, paragraphs, simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(nodes, linked):
    """Smallest member of each node's component."""
    home = {x: x for x in nodes}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            p, q = sorted((root(a), root(b)))
            home[q] = p
    return {x: root(x) for x in nodes}


def test_masks_cover_every_pair():
    for radius in (1, 2):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_links_by_hand(spark):
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(60)} | {0, 2 ** 64 - 1}
    for p in list(prints):  # chains, dense balls and lone ones
        for _ in range(r.randrange(0, 5)):
            p ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 1, 2, 3])))
            prints.add(p)
    prints |= {next(iter(prints)) ^ (1 << b) for b in range(40)}
    signed = {simhash.signed(p): p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for radius in (1, 2):
        edges = simhash.links(df, radius)
        assert all((signed[x.a] ^ signed[x.b]).bit_count() <= radius for x in edges.collect())
        got = {x.node: x.root for x in components.components(edges).collect()}
        want = grouped(sorted(signed), lambda a, b: (signed[a] ^ signed[b]).bit_count() <= radius)
        assert {s: got.get(s, s) for s in signed} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_by_hand(spark):
    r = random.Random(10)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(40)) for _ in range(n)) for n in (1, 2, 3, 40, 400, 400)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(10 + i, t.upper().replace(" ", "\n"), "s") for i, t in enumerate(base)]
    rows += [(30 + i, base[4] + " tail" * i, "s") for i in range(4)] + [(7, base[5], "s")] * 3
    df = tables.documents(spark, rows).unionByName(tables.awkward(spark))
    got = simhash.near_duplicates(df).select("doc_id", "text", "fingerprint", "component_id", "component_print").collect()
    prints = {x.text: fingerprint(x.text) for x in got}
    home = grouped(sorted(set(prints.values()), key=simhash.signed), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for x in got:
        if x.doc_id is not None:
            at = home[prints[x.text]]
            least[at] = min(least.get(at, x.doc_id), x.doc_id)
    assert len(got) == len(rows) + 13
    for x in got:
        assert int(x.fingerprint, 16) == prints[x.text] and x.component_id == least.get(home[prints[x.text]])
    kept = simhash.deduplicated(df).collect()
    assert len(kept) == len(set(home[p] for p in prints.values()))
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(least.values())
    assert tables.schema_of(simhash.deduplicated(df)) == tables.schema_of(df)
    assert simhash.near_duplicates(tables.empty(spark)).count() == 0


def test_edited_copies_are_linked_by_similarity(spark):
    r = random.Random(15)
    rows, groups = [], 80
    for g in range(groups):
        base = words(r, r.choice([150, 300, 600])).split()
        for c in range(3):
            text = list(base)
            for at in r.sample(range(len(text)), max(1, len(text) // 200)):
                text[at] = words(r, 1)
            rows.append((3 * g + c, " ".join(text), "s"))
    clean = [(1000 + i, words(r, 150), "s") for i in range(100)]
    kept = {x.doc_id for x in simhash.deduplicated(tables.documents(spark, rows + clean), similarity=0.8).collect()}
    left = [len(kept & {3 * g, 3 * g + 1, 3 * g + 2}) for g in range(groups)]
    assert kept >= {i for i, _, _ in clean} and min(left) == 1 and sum(x == 1 for x in left) >= 0.9 * groups
    awkward = tables.awkward(spark)
    assert simhash.deduplicated(awkward, similarity=0.8).count() == simhash.deduplicated(awkward).count()
    assert simhash.deduplicated(tables.empty(spark), similarity=0.8).count() == 0


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(n))


def test_repeated_passages(spark):
    r = random.Random(11)
    passages = [words(r, n) for n in (51, 60, 80, 200)]
    rows, planted, n = [], set(), 0
    for p in passages:
        for _ in range(3):  # inside a longer paragraph, in a document of other text
            rows.append((n, words(r, r.randrange(0, 90)) + " " + p + " " + words(r, r.randrange(0, 90)) + "\n" + words(r, 30), "s"))
            planted.add(n)
            n += 1
    line = words(r, 100).split()
    changed = line[:50] + ["other"] + line[51:]
    for text in (line, changed):
        rows.append((n, words(r, 40) + "\n" + " ".join(text).upper(), "s"))
        planted.add(n)
        n += 1
    clean = set(range(1000, 1060))
    rows += [(i, "\n".join(words(r, r.randrange(1, 120)) for _ in range(4)), "s") for i in clean]
    own = words(r, 60)
    rows.append((2000, own + "\n" + own, "s"))  # only within itself
    got = paragraphs.repeated(tables.documents(spark, rows)).collect()
    assert {x.id for x in got} == planted
    by = {}
    for x in got:
        by.setdefault(x.class_id, []).append(x)
    for xs in by.values():
        assert sum(x.kept for x in xs) == 1 and min(x.id for x in xs) == next(x.id for x in xs if x.kept)
    texts = {i: (t or "").lower().split() for i, t, _ in rows}
    for xs in by.values():
        if all(x.words <= 40 for x in xs):
            assert len({tuple(texts[x.id][x.word:x.word + x.words]) for x in xs}) == 1


def test_near_paragraphs_recall(spark):
    r = random.Random(12)
    rows, pairs = [], []
    for i in range(150):
        a = words(r, 100).split()
        b = list(a)
        for at in r.sample(range(100), r.randrange(1, 4)):
            b[at] = words(r, 1)
        rows += [(2 * i, " ".join(a), "s"), (2 * i + 1, " ".join(b), "s")]
        s, t = ({tuple(x[k:k + 5]) for k in range(96)} for x in (a, b))
        if len(s & t) >= 0.8 * len(s | t):
            pairs.append((2 * i, 2 * i + 1))
    got = paragraphs.repeated(tables.documents(spark, rows)).where("words = 100").groupBy("class_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    found = {tuple(x.ids) for x in got}
    assert len(pairs) > 60 and found <= set(pairs) and len(found) >= 0.95 * len(pairs)


def test_paragraphs_awkward(spark):
    got = paragraphs.repeated(tables.awkward(spark).unionByName(tables.documents(spark, [(None, "a b c d e f", "s"), (None, "A B C D E F", None), (11, "x\na b c d e f", "s"), (12, "of " * 200, "s"), (13, "q r s t u " + "of " * 300, "s")])))
    rows = sorted((x.id is None, x.id or 0, x.word, x.words, x.kept) for x in got.collect())
    assert (False, 11, 1, 6, True) in rows and sum(x[0] for x in rows) == 2 and {12, 13} <= {x[1] for x in rows}
    assert paragraphs.repeated(tables.empty(spark)).count() == 0


def jaccard(a, b):
    s, t = ({tuple(x[k:k + 5]) for k in range(len(x) - 4)} for x in (a.split(), b.split()))
    return len(s & t) / len(s | t)


def boilerplate_pairs(r, pairs, shares, length=100):
    """Texts two by two, alike by about 0.84, all of which share their first words with all others."""
    common = words(r, length).split()
    texts = []
    for i in range(pairs):
        held = int(length * shares[i % len(shares)])
        a = common[:held] + words(r, length - held).split()
        b = list(a)
        b[r.randrange(held + 3, length - 3)] = words(r, 1) + "x"
        b[r.randrange(3, held - 3)] = words(r, 1) + "y"
        texts += [" ".join(a), " ".join(b)]
    return texts


def test_near_pairs_among_shared_boilerplate_are_all_linked(spark):
    r = random.Random(16)
    texts = boilerplate_pairs(r, 400, (0.5, 0.6, 0.7, 0.8))
    units = next(paragraphs.list_units([pa.record_batch({"row": list(range(len(texts))), "id": list(range(len(texts))), "text": texts})])).to_pylist()
    whole = [u for u in units if u["bands"]]
    at = {u["digest"]: u["row"] for u in whole}
    bands = {u["row"]: set(u["bands"]) for u in whole}
    edges = paragraphs.near_links(spark.createDataFrame([(u["digest"], u["bands"], u["text"]) for u in whole], "digest long, bands array<long>, text string"))
    got = {at[x.node]: x.root for x in components.components(edges).collect()}
    assert all(jaccard(texts[at[x.a]], texts[at[x.b]]) >= 0.8 for x in edges.collect())
    near = [(i, i + 1) for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8 and bands[i] & bands[i + 1]]
    assert len(near) > 350 and all(i in got and got[i] == got.get(j) for i, j in near)
    # what is alike across pairs is linked as well
    for i, j in itertools.combinations(range(0, len(texts), 7), 2):
        if bands[i] & bands[j] and jaccard(texts[i], texts[j]) >= 0.8:
            assert got[i] == got[j]


def test_similarity_of_texts_is_decided_exactly(spark):
    r = random.Random(17)
    texts, pairs = [], []
    for i in range(300):
        a = words(r, 150).split()
        b = list(a)
        for at in r.sample(range(5, 145), 3 + i % 3):
            b[at] = words(r, 1) + "x"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(a), " ".join(b)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    edges = simhash.similar_links(tables.documents(spark, rows, False).withColumn("_fp", F.col("doc_id")), F.col("text"), 0.8).collect()
    found = {(min(x.a, x.b), max(x.a, x.b)) for x in edges}
    near = {(i, j) for i, j in pairs if jaccard(texts[i], texts[j]) >= 0.8}
    assert 100 < len(near) < 250 and found <= near and len(found) >= 0.97 * len(near)


def test_every_text_of_a_fingerprint_is_linked(spark):
    r = random.Random(18)
    rows = []
    for g in range(40):  # fingerprint g has two unlike texts, and each of them a near copy with a fingerprint of its own
        for k in (1, 2):
            text = words(r, 100)
            rows += [(g, text), (1000 * k + g, text + " tail")]
    hashed = spark.createDataFrame(rows, "_fp long, text string")
    edges = {(x.a, x.b) for x in simhash.similar_links(hashed, F.col("text"), 0.8).collect()}
    both = {(min(e), max(e)) for e in edges}
    assert both == {(g, 1000 * k + g) for g in range(40) for k in (1, 2)}


def test_passages_wrapped_differently_are_found(spark):
    r = random.Random(19)
    rows, clean = [], set(range(1000, 1060))

    def wrapped(text, width):
        split = text.split()
        return "\n".join(" ".join(split[i:i + width]) for i in range(0, len(split), width))

    for p in range(40):
        passage = words(r, 60)
        for c, width in enumerate((8, 15, 40)):  # with other text before and behind, so that it begins inside a line
            rows.append((3 * p + c, wrapped(words(r, r.randrange(1, 40)) + " " + passage + " " + words(r, r.randrange(1, 40)), width), "s"))
    rows += [(i, wrapped(words(r, 200), r.choice([8, 15, 40])), "s") for i in clean]
    got = paragraphs.repeated(tables.documents(spark, rows)).collect()
    assert {x.id for x in got} == set(range(120))
    texts = {i: t.lower().split() for i, t, _ in rows}
    by = {}
    for x in got:
        by.setdefault(x.class_id, []).append(x)
    for xs in by.values():
        assert sum(x.kept for x in xs) == 1 and len({x.id // 3 for x in xs}) == 1
        assert len({tuple(texts[x.id][x.word:x.word + x.words]) for x in xs}) == 1


def test_spans_are_repeated_word_for_word(spark):
    r = random.Random(20)
    stock = [words(r, 6) for _ in range(60)]
    rows, phrases = [], set(range(1000, 1012))
    for p in range(30):
        passage, line = words(r, 60), words(r, 30)
        for c in range(3):  # inside a line, and as a line with a phrase behind it
            rows.append((3 * p + c, words(r, r.randrange(1, 40)) + " " + passage + " " + words(r, r.randrange(1, 40)), "s"))
            rows.append((200 + 3 * p + c, words(r, 9) + "\n" + line + "\n" + r.choice(stock), "s"))
    rows += [(i, "\n".join(r.sample(stock, 8)), "s") for i in phrases]
    units = paragraphs.repeated(tables.documents(spark, rows))
    got = paragraphs.spans(units).collect()
    texts = {i: (t or "").lower().split() for i, t, _ in rows}
    plain = {i: " " + " ".join(t) + " " for i, t in texts.items()}
    for x in got:
        stretch = " " + " ".join(texts[x.id][x.word:x.word + x.words]) + " "
        assert x.words >= paragraphs.LEAST_SPAN and any(stretch in t for i, t in plain.items() if i != x.id)
    found = {x.id for x in got}
    assert {200 + i for i in range(90)} <= found and not found & phrases
    assert len(found & set(range(90))) >= 86
    by = {}
    for x in got:
        by.setdefault(x.id, []).append(x.words)
    assert all(30 <= max(by[i]) <= 36 for i in range(200, 290))
    assert paragraphs.spans(units.where("false")).count() == 0


def plain_cuts(codes):
    """Where a stretch of words is cut: at hashes of three words that are the least of REACH on either side, and along one word again and again."""
    three, reach = [int(x) for x in paragraphs.rolling(codes, 3)], paragraphs.REACH
    cuts = {0} | {i for i, x in enumerate(three) if all(x < y for y in three[max(0, i - reach):i]) and all(x <= y for y in three[i + 1:i + 1 + reach])}
    i = 0
    while i < len(three) - 1:
        end = i
        while end < len(three) - 1 and three[end] == three[end + 1]:
            end += 1
        cuts |= set(range(i, end, paragraphs.SAME))
        i = end + 1
    return sorted(cuts)


def test_units_of_many_texts_are_made_at_once(monkeypatch):
    r = random.Random(21)
    texts = [None, "", " \n ", "a b c d", " A  b\tc\x0bd\x0ce ", "of " * 300, "q r s t u " + "of " * 90 + "\n" + "of " * 50]
    texts += ["".join(r.choice(["a", "Bb", "ö", "x\x1cy"]) + r.choice([" ", " ", "  ", "\n"]) for _ in range(r.randrange(150))) for _ in range(60)]
    texts += ["\n".join(words(r, r.randrange(1, 130)) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    expected = []
    for i, text in enumerate(texts):
        spans, place, stream, banded = set(), 0, [], set()
        for line in (text or "").encode().lower().split(b"\n"):
            found = line.split()
            stream += found
            n = len(found)
            if n >= paragraphs.SHINGLE:
                spans.add((place, place + n))
                banded |= {(place, place + n)} if n >= paragraphs.LEAST_BANDED else set()
            if n > paragraphs.LONG:
                cuts = plain_cuts(np.array([xxhash.xxh64_intdigest(w) for w in found], np.uint64))
                spans |= {(place + a, place + b) for a, b in zip(cuts, cuts[1:] + [n]) if b - a >= paragraphs.SHINGLE}
            place += n
        if place > paragraphs.LONG:
            cuts = plain_cuts(np.array([xxhash.xxh64_intdigest(w) for w in stream], np.uint64))
            spans |= {(a, b) for a, b in zip(cuts, cuts[1:] + [place]) if b - a >= paragraphs.SHINGLE}
        for a, b in spans:
            plain = b" ".join(stream[a:b])
            expected.append((i, a, b - a, xxhash.xxh64_intdigest(plain) - (1 << 63), plain.decode() if (a, b) in banded else None))
    calls, rolling = [], paragraphs.rolling
    monkeypatch.setattr(paragraphs, "rolling", lambda codes, length: calls.append(length) or rolling(codes, length))
    batch = pa.record_batch({"row": list(range(len(texts))), "id": list(range(len(texts))), "text": texts})
    units = [u for b in paragraphs.list_units([batch, batch.slice(0, 0)]) for u in b.to_pylist()]
    assert len(calls) <= 4  # not for each line
    got = [(u["row"], u["word"], u["words"], u["digest"], u["text"]) for u in units]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    for u in units:
        assert (u["bands"] is None) == (u["text"] is None)
        if u["bands"]:
            codes = np.array([xxhash.xxh64_intdigest(w) for w in u["text"].encode().split(b" ")], np.uint64)
            assert u["bands"] == paragraphs.signatures(rolling(codes, paragraphs.SHINGLE), np.array([0]))[0].view(np.int64).tolist()


def test_least_hashes_of_blocks_are_those_of_each_paragraph():
    lengths = np.array([3, 20_000, 1, 1, 9_000, 4, 4_000, 4_000])
    shingles, starts = np.random.default_rng(5).integers(0, 2 ** 63, lengths.sum()).astype(np.uint64), np.cumsum(lengths) - lengths
    found = paragraphs.minima(shingles, starts, paragraphs.MULTIPLIERS)
    for i, (a, n) in enumerate(zip(starts, lengths)):
        assert (found[i] == paragraphs.stirred(paragraphs.MULTIPLIERS[:, None] * shingles[None, a:a + n]).min(axis=1)).all()
