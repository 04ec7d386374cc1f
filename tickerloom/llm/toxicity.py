"""Toxicity after noisy-channel deobfuscation."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import seal, sealed_column, unseal, written

#: Symbols of the character model: 0 is the edge of a word, then these letters, then a digit, another letter, another sign.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß"
DIGIT_SIGN, OTHER_LETTER, OTHER_SIGN = len(LETTERS) + 1, len(LETTERS) + 2, len(LETTERS) + 3
SIGNS = len(LETTERS) + 4
#: What a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t",
        "€": "e", "£": "l", "¡": "i", "(": "c"}
#: Signs that may be strewn into a word.
FILLERS = frozenset(".-_*~'`^:;,/\\·•|#%&=")
#: Logarithms of the channel: a letter written as a sign, and a sign, a repeated letter or a blank put in. A letter left out of the
#: output also saves its share of the language model (about -2.5), which these make up for. Between single signs a blank that parts words is rarer
#: than one that was put in.
SUBSTITUTED, FILLED, REPEATED, SPACED, PARTED = -2.0, -3.0, -4.5, -1.0, -4.0
DOUBTFUL = re.compile(r"(.)\1|[0-9@$!|+€£¡(.\-_*~'`^:;,/\\·•#%&=]")
#: What has more than one way through the lattice: a sign after the same one, and the signs above.
AMBIGUOUS = re.compile(r"(?<=(.))\1|" + DOUBTFUL.pattern.split("|", 1)[1])
LETTER = re.compile(r"[^\W\d_]")
OUTER = ".,;:!?|*#%&\"'()[]{}<>«»„“”…-_~`"
SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]{1,2}\S(?!\S)){2,}")
#: What every run of single signs holds, found faster than the run itself.
IN_SINGLES = re.compile(r"[ \t]\S[ \t]{1,2}\S(?!\S)")
PREFIXES = range(3, 9)
#: Signs of a feature's stem: all features of a word begin with them, for no beginning is shorter.
STEM = 3
#: Labelled rows the classifier is fitted on at most, chosen by a hash of their id.
SAMPLE = 20_000
#: Toxic rows of the sample that must hold a feature.
SUPPORT = 4
KNOWN = 200_000
#: Ways through the lattice of a token that are looked up before it is decoded.
WAYS = 4
CHARS = 400_000


def sign_table() -> np.ndarray:
    table = np.full(0x250, OTHER_SIGN, np.uint8)
    for c in range(0x250):
        x = chr(c)
        table[c] = 0 if x.isspace() else LETTERS.index(x) + 1 if x in LETTERS else DIGIT_SIGN if x.isdigit() else OTHER_LETTER if x.isalpha() else OTHER_SIGN
    return table


TABLE = sign_table()
CODE = {chr(c): int(TABLE[c]) for c in range(0x250)}


def code(x: str) -> int:
    found = CODE.get(x)
    return found if found is not None else 0 if x.isspace() else OTHER_LETTER if x.isalpha() else OTHER_SIGN


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character trigrams of all texts of a task, words set apart by two edges."""
    counts = np.zeros(SIGNS ** 3, np.int64)

    def take(text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(points < 0x250, TABLE[np.minimum(points, 0x24F)], OTHER_LETTER).astype(np.int64)
        codes = np.repeat(codes, np.where(codes == 0, 2, 1))
        counts[:] += np.bincount(codes[:-2] * SIGNS ** 2 + codes[1:-1] * SIGNS + codes[2:], minlength=SIGNS ** 3)

    held, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for at in range(0, len(text or ""), CHARS):
                held.append(text[at:at + CHARS].lower())
                size += len(held[-1])
                if size >= CHARS:
                    take(" " + " ".join(held) + " ")
                    held, size = [], 0
    if held:
        take(" " + " ".join(held) + " ")
    seen = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities [a, b, c] of sign c after a and b, from the trigram counts of all texts; smoothed by shorter contexts.

    The counts are summed by Spark; what reaches the driver is bounded by the number of trigrams of signs."""
    counts = np.zeros(SIGNS ** 3)
    for gram, n in docs.mapInArrow(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    three = counts.reshape(SIGNS, SIGNS, SIGNS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    single = (one + 1) / (one.sum() + SIGNS)
    double = (two + 5 * single) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * double) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def core_of(token: str) -> str:
    return token.strip(OUTER) if token[-1:] not in "!" else token.rstrip("?.,;:").strip("\"'([{<«„“")


def may_begin(core: str, stems: frozenset[str]) -> bool:
    """False only if no way through the lattice of the core gives a word that begins with one of the stems. Follows the first signs of all outputs."""
    if not core:
        return False
    if " " in core or not LETTER.match(core):  # several words, or signs at the front that may go
        return True
    begun, before = {""}, ""
    for x in core:
        longer = {b + y for b in begun for y in x + LEET.get(x, "")}
        if any(b[-1] in OUTER or (len(b) == STEM and b in stems) for b in longer):  # outer signs may be stripped
            return True
        if not (x in FILLERS or (x == before and LETTER.match(x))):
            begun = set()
        begun |= {b for b in longer if len(b) < STEM}
        if not begun:
            return False
        before = x
    return not begun.isdisjoint(stems)


def stem_number(stem: str) -> int:
    """The signs of a stem as one long, so that sums by feature stay a hash aggregate."""
    return sum(ord(x) << 21 * i for i, x in enumerate(stem))


def stem_of(number: int) -> str:
    return "".join(chr(x) for x in (number >> 21 * i & 0x1FFFFF for i in range(STEM)) if x)


class Decoder:
    """The most likely word behind an obfuscated one: Viterbi over the lattice of what each sign may stand for."""

    def __init__(self, model: np.ndarray):
        self.model = model.ravel().tolist()

    def decode(self, written_: str) -> str:
        """States are the last two signs of the output; arcs keep a sign, replace it by a letter, or leave it out (a filler, a
        repetition, a blank between single signs). Linear in the length of the input."""
        model, states = self.model, {0: (0.0, None)}
        before = ""
        for x in written_:
            own, leet = code(x), LEET.get(x, "")
            if own and not leet and x not in FILLERS and (x != before or not LETTER.match(x)):  # one arc, nothing may be left out
                found = {}
                for state, (score, path) in states.items():
                    s, to = score + model[state * SIGNS + own], state % SIGNS * SIGNS + own
                    if to not in found or found[to][0] < s:
                        found[to] = (s, (path, x))
                states, before = found, x
                continue
            arcs = [(own, x, 0.0)] + [(CODE[y], y, SUBSTITUTED) for y in leet]
            if x == " ":
                drop = SPACED
            elif x == before and LETTER.match(x):
                drop = REPEATED
            else:
                drop = FILLED if x in FILLERS else None
            found = {}
            for state, (score, path) in states.items():
                if drop is not None and (state not in found or found[state][0] < score + drop):
                    found[state] = (score + drop, path)
                low = state % SIGNS * SIGNS
                for sign, y, cost in arcs:
                    s = score + cost + model[state * SIGNS + sign]
                    if sign == 0:  # the edge of a word is two edges
                        s += model[low * SIGNS] + PARTED
                        to = 0
                    else:
                        to = low + sign
                    if to not in found or found[to][0] < s:
                        found[to] = (s, (path, y))
            states, before = found, x
        _, path = max(((score + model[state * SIGNS], path) for state, (score, path) in states.items()), key=lambda t: t[0])
        out = []
        while path is not None:
            path, y = path
            out.append(y)
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """The restored words of a lower-case token, or of single signs set apart by blanks. A token whose lattice has one path is its own."""
        core = core_of(token)
        if not LETTER.search(core):
            return [core] if core else []
        if DOUBTFUL.search(core) or " " in core:
            return [w for w in (x.strip(OUTER) for x in self.decode(core).split(" ")) if w] or [core]
        return [core]


def features(word: str) -> list[int]:
    """The word and its beginnings, as numbers."""
    return [xxhash.xxh64_intdigest(word) >> 1] + [xxhash.xxh64_intdigest(word[:k] + "\x00") >> 1 for k in PREFIXES if k < len(word)]


def tokens(text: str | None) -> set[str]:
    low = (text or "").lower()
    found = set(low.split())
    if IN_SINGLES.search(low):
        found.update(m.group(0) for m in SINGLES.finditer(low))
    return found


def count_features(model: np.ndarray):
    """Rows of the sample that hold each feature, by label and half, summed over a task; and the feature's stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known = Decoder(model), {}
        for batch in batches:
            counts: dict[int, list] = {}
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns)):
                held = {}
                for t in tokens(text):
                    got = known.get(t)
                    if got is None:
                        if len(known) > KNOWN // 4:
                            known.clear()
                        got = known[t] = {f: stem for w in decoder.words(t) for stem in (stem_number(w[:STEM]),) for f in features(w)}
                    held.update(got)
                at = 2 * half + label
                for f, stem in held.items():
                    if f not in counts:
                        counts[f] = [0, 0, 0, 0, stem]
                    counts[f][at] += 1
            columns = list(zip(*counts.values())) if counts else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64())] + [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())],
                                             names=["feature", "c0", "t0", "c1", "t1", "stem"])

    return run


def ways(core: str, most: int = WAYS) -> list[str] | None:
    """All outputs of the lattice of a core without blanks, or None if there are more than ``most``."""
    found, at = [""], 0
    for m in AMBIGUOUS.finditer(core):
        i = m.start()
        x, held = core[i], core[at:i]
        options = [x, *LEET.get(x, "")]
        if x in FILLERS or (core[i - 1:i] == x and LETTER.match(x)):
            options.append("")
        found, at = [b + held + y for b in found for y in options], i + 1
        if len(found) > most:
            return None
    return [b + core[at:] for b in found]


class Beginnings(dict):
    """The largest weight of a word's beginnings up to one of them; a beginning that many words share is hashed once."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, beginning: str) -> float:
        found = self.weights.get(xxhash.xxh64_intdigest(beginning + "\x00") >> 1, 0.0)
        if len(beginning) > PREFIXES[0]:
            found = max(found, self[beginning[:-1]])
        self[beginning] = found
        return found


class Weights(dict):
    """Token to the largest weight of its features; 0 if none speaks for toxicity.

    Only tokens of which a word may begin with the stem of a weighted feature are looked at: all others have no weight whatever they stand for;
    and a token is decoded only if its ways through the lattice are many or differ in weight. Of tokens seen long ago the older half is forgotten."""

    def __init__(self, decoder: Decoder, weights: dict[int, float], stems: frozenset[str]):
        super().__init__()
        self.decoder, self.weights, self.stems = decoder, weights, stems
        self.sure: dict[str, bool] = {}
        self.beginnings = Beginnings(weights)
        self.older: dict[str, float] = {}

    def of_word(self, word: str) -> float:
        """The largest weight of the word and its beginnings."""
        found, n = self.weights.get(xxhash.xxh64_intdigest(word) >> 1, 0.0), min(len(word) - 1, PREFIXES[-1])
        return max(found, self.beginnings[word[:n]]) if n >= PREFIXES[0] else found

    def of_core(self, token: str, core: str) -> float:
        if " " not in core:
            if not DOUBTFUL.search(core) or not LETTER.search(core):
                return self.of_word(core)
            outputs = ways(core)
            if outputs is not None:
                found = {self.of_word(x.strip(OUTER) or core) for x in outputs}
                if len(found) == 1:
                    return found.pop()
        return max(map(self.of_word, self.decoder.words(token)), default=0.0)

    def __missing__(self, token: str) -> float:
        found = self.older.get(token)
        if found is None:
            core = core_of(token)
            stem = core[:STEM]
            begins = self.sure.get(stem)
            if begins is None:
                begins = may_begin(core, self.stems)
                if len(stem) == STEM and stem.isalpha() and not DOUBTFUL.search(stem):  # letters that stand for themselves decide, whatever follows
                    self.sure[stem] = begins
            found = self.of_core(token, core) if begins else 0.0
        self[token] = found
        return found

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """The largest and second largest weight of the text's tokens and the logarithm of how many have one."""
        if len(self) > KNOWN:
            self.older = dict(self)
            for held in (self, self.sure, self.beginnings):
                held.clear()
        if len(self.beginnings) > KNOWN:
            self.beginnings.clear()
        held = sorted(x for x in map(self.__getitem__, tokens(text)) if x > 0)
        return (held[-1] if held else 0.0, held[-2] if len(held) > 1 else 0.0, math.log1p(len(held)))


def evidence_of(model: np.ndarray, halves: dict[int, tuple[dict[int, float], frozenset[str]]]):
    """The evidence in sample rows, weighed by what the other half of the sample says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = {h: Weights(Decoder(model), *halves[1 - h]) for h in (0, 1)}
        for batch in batches:
            text, label, half = (c.to_pylist() for c in batch.columns)
            found = [weights[h].evidence(t) for t, h in zip(text, half)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in range(3)] + [pa.array(label, pa.int32())], names=["a", "b", "c", "label"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b, penalty = np.zeros(x.shape[1]), ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def scorer(model: np.ndarray, weights: dict[int, float], stems: frozenset[str], coefficients: np.ndarray):
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Weights(Decoder(model), weights, stems)
        for texts in batches:
            x = np.array([known.evidence(t) for t in texts], dtype=float).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ coefficients[:3] + coefficients[3], -30, 30))), dtype="float64")

    return scored


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, support: int = SUPPORT, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "toxic", folds: int = 5) -> DataFrame:
    """Adds held_out, score and predicted to every row.

    A character model counts the trigrams of all texts. Tokens, and runs of single signs set apart by blanks, are restored by Viterbi
    decoding; the words and their beginnings that speak for toxicity in the fitting rows are weighed by smoothed log-odds; a
    document's evidence (largest, second largest, how many) goes through a logistic curve fitted on cross-fitted evidence. Only labels of rows whose
    crc32 of the id as text is not a multiple of ``folds`` are used, at most ``sample`` of them, chosen by a hash of the id; every
    row is scored, its whole text read. Neither label, id nor other columns enter a score.

    Null and empty texts have no evidence and get the score of that. Labels that are null or of a null id count for nothing; of several for an id the
    largest counts. If the labels at hand are all 0 (or none) every score is 0, if all 1 it is 1. Repeated rows are scored each. Input columns
    named like an added one are replaced. An empty table gives no rows."""
    rows, names = seal(docs)
    ident, text = F.col(sealed_column(names, id_column)), F.col(sealed_column(names, text_column))
    held_out = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == 0, F.lit(False))
    marks, mark_names = seal(labels)
    mark_id, mark = F.col(sealed_column(mark_names, id_column)), F.col(sealed_column(mark_names, label_column))
    chosen = (marks.where(mark_id.isNotNull() & mark.isNotNull() & (F.crc32(mark_id.cast("string").cast("binary")) % folds != 0))
              .groupBy(mark_id.alias("_id")).agg(F.max((mark > 0).cast("int")).alias("label"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    fitting = written(rows.join(F.broadcast(chosen), ident == F.col("_id"))  # at most ``sample`` rows
                      .groupBy("_id", "label").agg(F.min(text).alias("text"))
                      .select("text", "label", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)).cast("int").alias("half")))
    sizes = {(r["half"], r["label"]): r["count"] for r in fitting.groupBy("half", "label").count().collect()}
    total = [sum(n for (_, label), n in sizes.items() if label == y) for y in (0, 1)]
    if not (total[0] and total[1]):
        scored = rows.withColumn("score", F.lit(1.0 if total[1] else 0.0))
    else:
        model = character_model(rows.select(text))
        counts = fitting.mapInArrow(count_features(model), "feature long, c0 long, t0 long, c1 long, t1 long, stem long").groupBy("feature").agg(
            *[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")], F.min("stem").alias("stem")).where(F.col("t0") + F.col("t1") >= support)
        seen = counts.collect()  # bounded by what ``sample`` rows hold

        def weigh(toxic: int, clean: int, of_toxic: int, of_clean: int) -> float:
            return math.log((toxic + 0.5) / (of_toxic + 1)) - math.log((clean + 0.5) / (of_clean + 1))

        def table(halves: tuple[int, ...], least: int) -> tuple[dict[int, float], frozenset[str]]:
            of = [sum(sizes.get((h, y), 0) for h in halves) for y in (0, 1)]
            made, stems = {}, set()
            for r in seen:
                toxic, clean = sum(r[f"t{h}"] for h in halves), sum(r[f"c{h}"] for h in halves)
                if toxic >= least and (w := weigh(toxic, clean, of[1], of[0])) > 1:
                    made[r["feature"]] = w
                    stems.add(stem_of(r["stem"]))
            return made, frozenset(stems)

        crossed = {0: table((0,), support // 2), 1: table((1,), support // 2)}
        evidence = np.array([tuple(r) for r in fitting.select("text", "label", "half").mapInArrow(evidence_of(model, crossed), "a double, b double, c double, label int").collect()], dtype=float)
        coefficients = logistic(evidence[:, :3], evidence[:, 3])
        scored = rows.withColumn("score", scorer(model, *table((0, 1), support), coefficients)(text))
    judged = scored.withColumns({"held_out": held_out, "predicted": (F.col("score") >= 0.5).cast("int")})
    return unseal(judged, names, ("held_out", "score", "predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` not predicted to be toxic, with their columns."""
    rows, names = seal(docs)
    columns = {c: sealed_column(names, settings.pop(c, d)) for c, d in (("id_column", "doc_id"), ("text_column", "text"))}
    marks = labels.withColumnRenamed("doc_id", columns["id_column"])
    return unseal(score(rows, marks, **columns, **settings).where("predicted = 0"), names)
