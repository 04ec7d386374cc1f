"""Benchmark decontamination by template windows."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import null_safe, seal, sealed_column, unseal, written
from tickerloom.llm.filters import filter_bits, held_digests, may_hold

#: Units that follow a number (fixed values).
UNITS = frozenset("""% ° cm mm km m mi ft in yd inch inches foot feet mile miles meter meters metre metres kg g mg lb lbs oz ounce ounces pound
pounds ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months
year years dollar dollars cent cents euro euros usd eur mph kmh hz khz mhz ghz w kw kwh v kb mb gb tb degrees percent""".split())
#: Given names that stand for any name at the start of a sentence, where a capital says nothing (fixed values).
NAMES = frozenset("""alice anna bob carol charlie david emily emma eve frank george grace henry jack james jane john kate lisa lucy maria
mark mary michael mike noah olivia paul peter rachel robert sam sarah sophia susan tom william""".split())
NUMBER, UNIT, NAME, WORD_KIND = 1, 2, 3, 0
PLACES = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>"}
#: What is stripped before and behind a token.
BEFORE = "!\"#&'()*+,-./:;<=>?@[\\]^`{|}~“”„«»‹›…–—¡¿’‘·•"
BEHIND = BEFORE + "$€£"
ENDS = ("", ".", "!", "?", ":", "…")
NUMERIC = re.compile(r"[$€£]?\d[\d.,:/]*")
ATTACHED = re.compile(r"(?<=\d)(?=[^\W\d_]|[%°])")
DIGIT = re.compile(r"\d")

WINDOW = 8
#: A window with fewer ordinary words than this says little as a template and only matches word for word.
LEAST_WORDS = 3
#: So many tokens in a row betray an item (a shorter item: all its tokens).
SPAN = 13
#: Shorter items are too common as phrases to betray anything.
SHORTEST_ITEM = 5
#: Distinct tokens a task remembers before it forgets them all.
KNOWN = 200_000
STEP, SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


class Tokens(dict):
    """Token to number; the tables hold what is known of each number. A token is looked at once."""

    def __init__(self):
        super().__init__()
        self.low: list[str] = []
        self.kind, self.capital, self.ends, self.literal = array("b"), array("b"), array("b"), array("Q")

    def __missing__(self, token: str) -> int:
        core = token.lstrip(BEFORE).rstrip(BEHIND)
        low = core.lower()
        kind, first = WORD_KIND, core[:1]
        if not first.isalpha() and NUMERIC.fullmatch(core):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif low in NAMES and first.isupper():
            kind = NAME
        self[token] = n = len(self.low)
        self.low.append(low)
        self.kind.append(kind)
        self.literal.append(digest(low))
        self.capital.append(kind == WORD_KIND and first.isupper() and core[1:].islower())
        self.ends.append(token.rstrip("\"'”»)")[-1:] in ENDS)
        return n

    def tables(self) -> tuple[np.ndarray, ...]:
        """Kinds, digests, capitals and sentence ends; not to be held while tokens are learnt."""
        return (np.frombuffer(self.kind, np.int8), np.frombuffer(self.literal, np.uint64), np.frombuffer(self.capital, np.bool_), np.frombuffer(self.ends, np.bool_))


def runs_hash(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` values: runs of 1, 2, 4, ... are put together, so it takes a few passes for any length."""
    n = len(values) - length + 1
    out, done = None, 0
    part, size, factor = values, 1, STEP
    while True:
        if length & size:
            out = part[:n].copy() if out is None else out * factor + part[done:done + n]
            done += size
        if 2 * size > length:
            return out * STEP + np.uint64(length)
        part = part[:-size] * factor + part[size:]
        size, factor = 2 * size, np.uint64(int(factor) ** 2 % 2 ** 64)


class Templates:
    """Template windows of texts: numbers, units after numbers and names become typed places, other words stay."""

    def __init__(self, window: int, least_words: int):
        self.window, self.least_words, self.known = window, least_words, Tokens()

    def windows(self, text: str, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, digests word for word, template digests, which of these say enough, kinds, token numbers) for each window
        length that the text has."""
        if len(self.known) > KNOWN:
            self.known = Tokens()
        if DIGIT.search(text):
            text = ATTACHED.sub(" ", text)
        found = text.split()
        ids = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        kind, literal, capital, ends = (table[ids] for table in self.known.tables())
        begins, counted = np.ones(len(ids), np.bool_), np.zeros(len(ids), np.bool_)
        begins[1:], counted[1:] = ends[:-1], kind[:-1] == NUMBER
        kind[(kind == UNIT) & ~counted] = WORD_KIND
        kind[(kind == WORD_KIND) & capital & ~begins] = NAME  # a capital inside a sentence
        template = literal.copy()
        for k, place in PLACES.items():
            template[kind == k] = digest(place)
        words = np.concatenate(([0], np.cumsum(kind == WORD_KIND)))
        for length in lengths:
            n = len(ids) - length + 1
            if n < 1:
                continue
            rough, exact = runs_hash(template, length), runs_hash(literal, length)
            exact ^= SALT  # word for word: another hash than that of the same tokens as a template
            loose = words[length:] - words[:n] >= min(self.least_words, length)
            yield length, exact ^ (exact >> np.uint64(29)), rough ^ (rough >> np.uint64(29)), loose, kind, ids

    def slots(self, at: int, length: int, kind: np.ndarray, ids: np.ndarray) -> list[str]:
        """What stands in the places of a template window."""
        return [self.known.low[ids[i]] for i in range(at, at + length) if kind[i] != WORD_KIND]


def scan(window: int, least_words: int, lengths, held: np.ndarray | None, whole_items: bool):
    """A function over Arrow batches (key, id, text) that lists (key, id, tokens, length, at, digest, slots) of windows: of
    documents those that the filter may hold, of items all of the one length they are matched by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(window, least_words)
        for batch in batches:
            row, tokens, long, place, digests, slots = [], [], [], [], [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                wanted = lengths
                if whole_items:
                    n = len((ATTACHED.sub(" ", text)).split())
                    wanted = [min(window, n)] if n >= SHORTEST_ITEM else []
                for length, exact, rough, loose, kind, ids in templates.windows(text, wanted):
                    for digest_, is_template in ((exact, False), (rough, True)):
                        hits = loose if is_template else np.ones(len(exact), np.bool_)
                        if held is not None:
                            hits = hits & may_hold(held, digest_)
                        at = np.nonzero(hits)[0]
                        row += [r] * len(at)
                        tokens += [len(ids)] * len(at)
                        long += [length] * len(at)
                        place += at.tolist()
                        digests += digest_[at].view(np.int64).tolist()
                        slots += [templates.slots(i, length, kind, ids) if is_template else [] for i in at.tolist()]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(tokens, pa.int32()), pa.array(long, pa.int32()),
                 pa.array(place, pa.int32()), pa.array(digests, pa.int64()), pa.array(slots, pa.list_(pa.string()))],
                names=["key", "id", "tokens", "length", "at", "digest", "slots"])

    return run


def listed(table: DataFrame, id_type: str, run) -> DataFrame:
    return table.mapInArrow(run, f"key long, id {id_type}, tokens int, length int, at int, digest long, slots array<string>")


def row_key(id_column, text_column):
    """Tells rows apart without a shuffle: equal rows share it, null ids and null texts have it too."""
    return F.xxhash64(null_safe(id_column), null_safe(text_column))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int = SPAN, least_words: int = LEAST_WORDS,
            id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(key, id, item_id, matched_tokens, item_tokens, at, changed_slots): one row per document row and benchmark item it holds.

    Texts are cut at blanks, stripped of outer punctuation and lower-cased; numbers, units after numbers and names (capitals inside
    a sentence, common given names anywhere) become typed places. Windows of ``window`` template tokens are hashed and joined;
    each is hashed word for word and, with ``least_words`` ordinary words or more, as a template. An item is held if, along one alignment, ``span``
    tokens in a row (the whole item, if shorter) match and, in that span, every value of the item's places stands for one value of the document; what
    stands elsewhere in the text plays no part. Neighbouring spans are one match. changed_slots counts its values that differ: 0 is a verbatim copy.

    Windows go to a shuffle only if a filter of bounded size, made from the benchmark's windows, may hold them; the exact join follows.
    Null and empty texts hold nothing; items under five tokens betray nothing. Repeated items are reported each, repeated rows
    once. Columns of the input play no part but for the two named. Empty tables give no rows."""
    spark = docs.sparkSession
    rows, names = seal(docs)
    ident, text = F.col(sealed_column(names, id_column)), F.col(sealed_column(names, text_column))
    items, item_names = seal(benchmark)
    item, item_text = F.col(sealed_column(item_names, item_column)), F.col(sealed_column(item_names, item_text_column))
    item_type = items.select(item).schema[0].dataType.simpleString()
    wanted = written(listed(items.select(F.monotonically_increasing_id(), item, item_text), item_type, scan(window, least_words, None, None, True)))
    found = wanted.groupBy("length").agg(F.count(F.lit(1))).collect()  # at most ``window`` rows
    held = held_digests(wanted, filter_bits(sum(r[1] for r in found)))
    hits = listed(rows.select(row_key(ident, text), ident, text), rows.select(ident).schema[0].dataType.simpleString(),
                  scan(window, least_words, sorted(r[0] for r in found), held, False))
    left = wanted.select("length", "digest", F.col("key").alias("item_key"), F.col("id").alias("item_id"), F.col("tokens").alias("item_tokens"),
                         F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    joined = hits.join(left, ["length", "digest"]).where(F.size("slots") == F.size("item_slots"))
    place = ["key", "id", "item_key", "item_id", "item_tokens", "length", "shift"]
    need = F.least(F.lit(span), F.col("item_tokens")) - F.col("length") + 1  # windows of a span
    window_pairs = joined.select(*place[:-1], (F.col("at") - F.col("item_at")).alias("shift"), "item_at", need.alias("need"), F.arrays_zip("item_slots", "slots").alias("pairs"))
    # a window belongs to every span it lies in, and each span is judged by its own windows alone
    spans = window_pairs.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("item_at") - F.col("need") + 1), F.least(F.col("item_at"), F.col("item_tokens") - F.col("length") - F.col("need") + 1))).alias("start"))
    judged = spans.groupBy(*place, "need", "start").agg(F.count_distinct("item_at").alias("windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    same = F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"]))) == F.size("pairs")
    line = Window.partitionBy(*place).orderBy("start")  # bounded by the item's tokens
    good = judged.where((F.col("windows") == F.col("need")) & same).withColumn("island", F.col("start") - F.row_number().over(line)).groupBy(*place, "need", "island").agg(
        F.count(F.lit(1)).alias("spans"), (F.min("start") + F.col("shift")).alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")).withColumns({
            "matched_tokens": (F.col("spans") + F.col("need") + F.col("length") - 2).cast("int"),
            "changed_slots": F.size(F.filter("pairs", lambda p: p["item_slots"] != p["slots"]))})
    best = good.groupBy("key", "id", "item_key", "item_id", "item_tokens").agg(
        F.max(F.struct("matched_tokens", (-F.col("changed_slots")).alias("fewer"), (-F.col("at")).alias("earlier"))).alias("best"))
    return best.select("key", "id", "item_id", "best.matched_tokens", "item_tokens", (-F.col("best.earlier")).alias("at"), (-F.col("best.fewer")).alias("changed_slots"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    rows, names = seal(docs)
    held = matches(docs, benchmark, id_column=id_column, text_column=text_column, **settings).select(F.col("key").alias("_key")).distinct()
    keyed = rows.withColumn("_key", row_key(F.col(sealed_column(names, id_column)), F.col(sealed_column(names, text_column))))
    return unseal(keyed.join(held, "_key", "left_anti"), names)
