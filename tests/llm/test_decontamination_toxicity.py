import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm import tables
from tickerloom.llm import decontamination, toxicity

ITEMS = "item_id long, text string, key string, at string"
QUESTION = "Last week Alice bought 12 apples for $3.50 at the market and then Alice gave 5 of the 12 apples, about 2 kg, to her brother."
LONG = "the quick brown fox jumps over the lazy dog while seven grey herons watch from the far bank of the slow river"


def held(spark, docs, items):
    df = tables.documents(spark, [(i, t, "s") for i, t in docs])
    table = spark.createDataFrame([(i, t, "k", "a") for i, t in items], ITEMS)
    got = decontamination.matches(df, table)
    left = {x.doc_id for x in decontamination.decontaminated(df, table).collect()}
    found = {(x.id, x.item_id): x for x in got.collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in found}
    return found


def test_matches(spark):
    docs = [
        (1, "Intro text. " + QUESTION + " More text follows."), (2, "so " + QUESTION.upper().replace(" ", "!! ")),
        (3, QUESTION.replace("Alice", "Susan").replace("12", "31").replace("5", "9").replace("$3.50", "$7").replace("2 kg", "9 lbs")),
        (4, QUESTION.replace("12 apples for", "31 apples for").replace("Alice bought", "Susan bought")),  # one value stands for two, but not in its last 21 tokens
        (5, "Nothing of the kind is in here, only apples and a market."), (6, None), (7, ""), (8, LONG.replace(" ", "\n")), (9, " ".join(LONG.split()[:9])),
        (10, " ".join(LONG.split()[2:17])), (11, "what is the answer now"), (12, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (13, "5 6 7 8 9 1 2 3 4 10 11 12 13 14"), (14, "filler " * 5000 + LONG)]
    items = [(100, QUESTION), (101, LONG), (102, "what is the answer now"), (103, "too short"), (104, None), (105, ""), (106, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (107, LONG)]
    found = held(spark, docs, items)
    assert set(found) == {(1, 100), (2, 100), (3, 100), (4, 100), (8, 101), (8, 107), (10, 101), (10, 107), (11, 102), (12, 106), (14, 101), (14, 107)}
    assert found[1, 100].changed_slots == 0 and found[3, 100].changed_slots >= 5 and found[10, 101].matched_tokens == 15


def test_matches_equal_brute_force_on_verbatim_passages(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    items = [(i, " ".join(word() for _ in range(r.randrange(5, 40)))) for i in range(40)]
    docs = []
    for i in range(150):
        text = [word() for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            part = r.choice(items)[1].split()
            a = r.randrange(len(part))
            text += part[a:a + r.randrange(1, 45)] + [word() for _ in range(10)]
        docs.append((i, " ".join(text)))
    found = held(spark, docs, items)

    def runs(d, t):
        a, b = d.split(), t.split()
        n = min(13, len(b))
        return any(a[i:i + n] == b[j:j + n] for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))

    assert set(found) == {(i, j) for i, d in docs for j, t in items if runs(d, t)}


def test_one_of_two_equal_values_changed(spark):
    """Thirty tokens word for word betray an item, whichever of two equal values is another in the document."""
    item = "a farmer who lives near the old mill sold 3 apples and 3 pears to the two travellers that came by on their way to the fair and asked for some fruit and bread to eat"
    docs = [(1, item.replace("3 apples", "4 apples")), (2, item.replace("3 pears", "7 pears")), (3, item.replace("3 apples", "4 apples").replace("3 pears", "4 pears")), (4, item[60:])]
    assert set(held(spark, docs, [(9, item)])) == {(1, 9), (2, 9), (3, 9), (4, 9)}


def test_template_spans_equal_brute_force(spark):
    """Every span of every alignment: kinds and ordinary words equal, each number of the item stands for one number of the document."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(3, 6)))
    token = lambda: str(r.randrange(1, 5)) if r.random() < 0.25 else word()
    items = [(i, " ".join(["q" + word(), *[token() for _ in range(r.randrange(13, 26))]])) for i in range(25)]
    docs = []
    for i in range(120):
        part = r.choice(items)[1].split()
        a = r.randrange(len(part))
        part = part[a:a + r.randrange(8, 30)]
        swap = {str(n): str(r.randrange(1, 9)) for n in range(1, 5)}
        part = [swap[t] if t in swap and r.random() < 0.9 else t for t in part]
        docs.append((i, " ".join([word() for _ in range(r.randrange(9))] + part + [word() for _ in range(5)])))
    found = held(spark, docs, items)

    def leaks(d, t, window=8):
        a, b = d.split(), t.split()
        n = min(13, len(b))
        for i in range(len(a) - n + 1):
            for j in range(len(b) - n + 1):
                x, y = a[i:i + n], b[j:j + n]
                if [t.isdigit() or t for t in x] != [t.isdigit() or t for t in y]:
                    continue
                loose = all(sum(not t.isdigit() for t in y[k:k + window]) >= 3 or x[k:k + window] == y[k:k + window] for k in range(n - window + 1))
                pairs = {(q, p) for p, q in zip(x, y) if q.isdigit()}
                if loose and len({q for q, _ in pairs}) == len(pairs):
                    return True
        return False

    assert set(found) == {(i, j) for i, d in docs for j, t in items if leaks(d, t)} and any(x.changed_slots for x in found.values())


def test_decontamination_awkward(spark):
    df = tables.awkward(spark)
    items = spark.createDataFrame([(1, LONG, "k", "a")], ITEMS)
    assert decontamination.decontaminated(df, items).count() == 13 and decontamination.decontaminated(df, items).columns == df.columns
    assert decontamination.decontaminated(df, items.limit(0)).count() == 13
    assert decontamination.matches(tables.empty(spark), items).count() == 0
    none = tables.documents(spark, [(None, LONG, "s"), (None, "other", "s"), (3, LONG, "s"), (3, "other", "s")])
    assert [(x.doc_id, x.text) for x in decontamination.decontaminated(none, items).orderBy("doc_id").collect()] == [(None, "other"), (3, "other")]


BAD = ["stupid", "worthless", "clown", "pathetic"]
HIDDEN = {"stupid": ["stup1d", "s t u p i d", "stuuupid", "s.t.u.p.i.d"], "worthless": ["w0rthless", "worth-less"], "clown": ["cl0wn", "c l o w n"], "pathetic": ["p@thetic", "pathetiic"]}


def corpus(spark, n=600):
    r = random.Random(14)
    stems = ["ban", "tor", "wil", "sten", "gre", "lo", "hin", "mer", "dat", "per"]
    rows, labels = [], []
    for i in range(n):
        text = ["".join(r.choice(stems) for _ in range(r.randrange(1, 4))) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                bad = r.choice(BAD)
                held_out = zlib.crc32(str(i).encode()) % 5 == 0
                text.insert(r.randrange(60), r.choice(HIDDEN[bad]) if held_out or r.random() < 0.2 else bad)
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int, text string, score string"


def label_table(spark, labels):
    return spark.createDataFrame([(*x, "t", "s") for x in labels], LABELS)


def test_held_out_accuracy_on_obfuscated_words(spark):
    rows, labels = corpus(spark)
    got = toxicity.score(tables.documents(spark, rows), label_table(spark, labels)).select("doc_id", "held_out", "score", "predicted").collect()
    truth = {i: t for i, _, t in labels}
    out = [x for x in got if x.held_out]
    assert {x.doc_id for x in out} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([x.predicted == truth[x.doc_id] for x in out]) >= 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark):
    rows, labels = corpus(spark, 300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = ({x.doc_id: x.score for x in toxicity.score(tables.documents(spark, [(i, t, s) for i, t, _ in rows]), label_table(spark, y)).collect()}
                for s, y in (("a", labels), ("b", turned)))
    assert one == two


def test_toxicity_awkward(spark):
    rows, labels = corpus(spark, 200)
    extra = [(None, 1, 1), (5, 1, None), (7, 1, 0), (7, 1, 0)]
    df = tables.documents(spark, rows).unionByName(tables.awkward(spark).withColumn("doc_id", F.col("doc_id") + 10_000))
    got = toxicity.score(df, label_table(spark, labels + extra))
    assert got.count() == 213 and got.columns.count("score") == 1
    assert got.where("text IS NULL OR text = ''").select("predicted", "score").distinct().collect()[0].predicted == 0
    kept = toxicity.without_toxic(df, label_table(spark, labels))
    assert tables.schema_of(kept) == tables.schema_of(df) and 140 <= kept.count() <= 180
    for marks, want in (([], 0.0), ([(i, 1, 1) for i in range(50)], 1.0), ([(i, 1, 0) for i in range(50)], 0.0)):
        assert {x.score for x in toxicity.score(df, label_table(spark, marks)).select("score").distinct().collect()} == {want}
    assert toxicity.score(tables.empty(spark), label_table(spark, labels)).count() == 0


def test_decoding_follows_the_best_path():
    """Against all outputs of the lattice, on a small model."""
    model = np.log(np.random.default_rng(1).dirichlet(np.ones(toxicity.SIGNS) * 0.3, (toxicity.SIGNS, toxicity.SIGNS)) + 1e-9).astype(np.float32)
    decoder = toxicity.Decoder(model)
    m = decoder.model

    def walk(text):
        found = [(0.0, 0, "")]
        for i, x in enumerate(text):
            nxt = []
            for score, state, out in found:
                for sign, y, cost in [(toxicity.code(x), x, 0.0)] + [(toxicity.CODE[y], y, toxicity.SUBSTITUTED) for y in toxicity.LEET.get(x, "")]:
                    nxt.append((score + cost + m[state * toxicity.SIGNS + sign], state % toxicity.SIGNS * toxicity.SIGNS + sign, out + y))
                if x in toxicity.FILLERS:
                    nxt.append((score + toxicity.FILLED, state, out))
                elif i and text[i - 1] == x and x.isalpha():
                    nxt.append((score + toxicity.REPEATED, state, out))
            found = nxt
        return max((s + m[state * toxicity.SIGNS], out) for s, state, out in found)

    for text in ("1d10t", "aab.b", "t-00-l", "m.o.r", "ssss", "a", "l33t$"):
        assert decoder.decode(text) == walk(text)[1]


def test_words_left_undecoded_have_no_weight():
    """Every token against decoding it: short words over letters, doubled letters, leet signs, fillers and outer signs."""
    r = random.Random(21)
    model = np.log(np.random.default_rng(2).dirichlet(np.ones(toxicity.SIGNS) * 0.3, (toxicity.SIGNS, toxicity.SIGNS)) + 1e-9).astype(np.float32)
    decoder = toxicity.Decoder(model)
    weighted = ["sto", "il", "a", "tes", "ba.", "lee"]
    weights = {f: 2.0 for w in weighted for f in toxicity.features(w)} | {f: 3.0 for f in toxicity.features("stoat")}
    known = toxicity.Weights(decoder, weights, frozenset(w[:toxicity.STEM] for w in [*weighted, "stoat"]))
    words = {"".join(r.choice("sstoailebx13@0.-'!(^") for _ in range(r.randrange(1, 8))) for _ in range(30_000)} | {"s t o a t", "b a .", "...", "!!", "", "st0at!"}
    for word in sorted(words):
        assert known[word] == max((weights.get(f, 0.0) for w in decoder.words(word) for f in toxicity.features(w)), default=0.0), word
    assert sum(known[w] > 0 for w in words) > 100


def test_single_signs_are_found_as_by_the_plain_pattern():
    r = random.Random(22)
    for _ in range(5000):
        text = "".join(r.choice("ab.  \t\n") for _ in range(r.randrange(0, 25)))
        assert toxicity.tokens(text) == set(text.split()) | {m.group(0) for m in toxicity.SINGLES.finditer(text)}


def test_stems_survive_as_numbers():
    assert all(toxicity.stem_of(toxicity.stem_number(x)) == x for x in ("", "a", "ab", "abc", "\u00fc\u20ac$", "\U0010ffff" * 3))
    assert toxicity.stem_number("\U0010ffff" * 3) < 2 ** 63


def test_tokens_whose_ways_weigh_the_same_are_not_decoded(monkeypatch):
    model = np.log(np.random.default_rng(3).dirichlet(np.ones(toxicity.SIGNS) * 0.3, (toxicity.SIGNS, toxicity.SIGNS)) + 1e-9).astype(np.float32)
    decoder, decoded = toxicity.Decoder(model), []

    class Counted(toxicity.Decoder):
        def decode(self, written_):
            decoded.append(written_)
            return super().decode(written_)

    weights = {f: 2.0 for f in toxicity.features("stall")} | {f: 3.0 for f in toxicity.features("steel")}
    known = toxicity.Weights(Counted(model), weights, frozenset({"sta", "ste"}))
    assert known["steppe"] == 3.0 and known["staffer's"] == 2.0 and known["stollen"] == 0.0 and not decoded  # by their beginnings, whatever the rest stands for
    for word in ("stall", "steel", "st-all", "s t a l l", "st33l", "ste.e.l"):  # ways that differ in weight, or many of them
        assert known[word] == max((weights.get(f, 0.0) for w in decoder.words(word) for f in toxicity.features(w)), default=0.0), word
    assert decoded
    # the same when most tokens have been forgotten in between
    r = random.Random(23)
    tokens = ["".join(r.choice("staeel3-pp") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    plain = {t: max((weights.get(f, 0.0) for w in decoder.words(t) for f in toxicity.features(w)), default=0.0) for t in tokens}
    monkeypatch.setattr(toxicity, "KNOWN", 5)
    known = toxicity.Weights(decoder, weights, frozenset({"sta", "ste"}))
    for _ in range(3):
        for i in range(0, len(tokens), 4):
            held = sorted(plain[t] for t in set(tokens[i:i + 4]) if plain[t] > 0)
            assert known.evidence(" ".join(tokens[i:i + 4]))[0] == (held[-1] if held else 0.0)
            assert len(known) <= 9 and len(known.older) <= 9


def test_ways_are_all_outputs_of_the_lattice():
    r = random.Random(24)
    for _ in range(3000):
        core = "".join(r.choice("aabl1|.-é²") for _ in range(r.randrange(0, 7)))
        found, before = [""], ""
        for x in core:
            options = [x, *toxicity.LEET.get(x, "")] + ([""] if x in toxicity.FILLERS or (x == before and toxicity.LETTER.match(x)) else [])
            found, before = [b + y for b in found for y in options], x
        got = toxicity.ways(core, 100_000)
        assert sorted(got) == sorted(found)
        assert toxicity.ways(core, 2) == (got if len(got) <= 2 else None)
