"""Packing of tokenized documents into sequences of fixed length, online, with a bounded number of open windows."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm.common import seal, sealed_column, written

#: Splits a text before merges; the vocabulary file names this rule "ByteLevel" with use_regex. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Leftover windows that one merging task takes.
FAN_IN = 64
#: Ids that a task collects before it hands over a batch of pieces.
BATCH_IDS = 1 << 20
PIECE = "start long, length long, ids binary, doc_tokens long"


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to id, and special strings to id, of a byte-level BPE file in the JSON of ``tokenizers``; read on the driver only.

    Ids follow the order of merges, so they are ranks as well. A file of another kind is an error."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    if told["model"]["type"] != "BPE" or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"] or told["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    # bytes that print stand for themselves, the others for the characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}, special


def encoding(vocabulary: tuple[dict[bytes, int], dict[str, int]]):
    """The vocabulary in the fastest library at hand; the tests hold its ids against ``tokenizers`` for every code point."""
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=vocabulary[0], special_tokens=vocabulary[1])


class Packer:
    """At most ``most`` open windows of ``length`` ids. A piece is (document, start, ids, the document's ids in all).

    A piece goes to the open window with the least space that holds it whole, else to a new window, and where no more may be opened the
    fullest one leaves: with ``cut`` the head of the piece fills it first, without it leaves as it is."""

    def __init__(self, length: int, most: int, cut: bool = True):
        self.length, self.most, self.cut = length, most, cut
        self.spaces: list[tuple[int, int]] = []  # (space, window), least space first
        self.windows: dict[int, list] = {}
        self.opened = 0
        self.full: list[list] = []

    def _put(self, space: int, window: int, piece) -> None:
        self.windows[window].append(piece)
        if space == len(piece[2]):
            self.full.append(self.windows.pop(window))
        else:
            insort(self.spaces, (space - len(piece[2]), window))

    def place(self, piece) -> None:
        doc, start, ids, total = piece
        while len(ids) >= self.length:  # whole windows of a long document need no place
            self.full.append([(doc, start, ids[:self.length], total)])
            start, ids = start + self.length, ids[self.length:]
        while len(ids):
            at = bisect_left(self.spaces, (len(ids), -1))
            if at < len(self.spaces):
                return self._put(*self.spaces.pop(at), (doc, start, ids, total))
            if len(self.spaces) < self.most:
                self.opened += 1
                self.windows[self.opened] = []
                return self._put(self.length, self.opened, (doc, start, ids, total))
            space, window = self.spaces.pop(0)
            if not self.cut:
                self.full.append(self.windows.pop(window))
                continue
            self._put(space, window, (doc, start, ids[:space], total))
            start, ids = start + space, ids[space:]

    def merge_leftovers(self) -> list:
        """Closes windows until at most one is open, whose pieces are returned: the emptiest window is dissolved again and again, its
        pieces go to the others, the largest first; one that no other holds whole is cut (without ``cut`` such windows leave as they are)."""
        self.most = 0
        while len(self.spaces) > 1:
            dissolved = self.windows.pop(self.spaces.pop()[1])
            loose = sorted(dissolved, key=lambda p: -len(p[2]))
            if not self.cut and not self._fit(loose):
                self.full.append(dissolved)
                continue
            while loose and self.spaces:
                piece = loose.pop(0)
                if bisect_left(self.spaces, (len(piece[2]), -1)) == len(self.spaces):  # held by none: only its head goes to the fullest
                    space, window = self.spaces.pop(0)
                    doc, start, ids, total = piece
                    self._put(space, window, (doc, start, ids[:space], total))
                    insort(loose, (doc, start + space, ids[space:], total), key=lambda p: -len(p[2]))
                else:
                    self.place(piece)
            if loose:
                self.opened += 1
                self.windows[self.opened] = loose
                self.spaces = [(self.length - sum(len(p[2]) for p in loose), self.opened)]
        last = self.windows.pop(self.spaces.pop()[1]) if self.spaces else []
        return last

    def _fit(self, pieces: list) -> bool:
        """Whether best fit places all the pieces whole in the open windows."""
        spaces = sorted(s for s, _ in self.spaces)
        for p in pieces:
            at = bisect_left(spaces, len(p[2]))
            if at == len(spaces):
                return False
            insort(spaces, spaces.pop(at) - len(p[2]))
        return True


def powers_of_two(pieces: Iterable) -> list[list]:
    """The pieces of one window as windows whose sizes are falling powers of two, which need no padding."""
    rest, out = list(pieces), []
    n = sum(len(p[2]) for p in rest)
    while n:
        size = 1 << (n.bit_length() - 1)
        window, n = [], n - size
        while size:
            doc, start, ids, total = rest.pop(0)
            if len(ids) > size:
                rest.insert(0, (doc, start + size, ids[size:], total))
                ids = ids[:size]
            window.append((doc, start, ids, total))
            size -= len(ids)
        out.append(window)
    return out


def _batch(windows: list[list], number: int, left: list, part: int, kind: pa.DataType) -> pa.RecordBatch:
    """Rows of finished windows, numbered from ``number`` on, and a row that holds what is left, if anything is."""
    rows = [(p[0], p[1], len(p[2]), p[2].tobytes(), p[3], number + w, sum(len(q[2]) for q in window[:i])) for w, window in enumerate(windows) for i, p in enumerate(window)]
    kinds = [("doc_id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    piece = pa.struct([kinds[i] for i in range(5)])
    held = [{"doc_id": d, "start": s, "length": len(x), "ids": x.tobytes(), "doc_tokens": n} for d, s, x, n in left]
    columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
    columns = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in columns] if held else columns
    n = len(columns[0])
    lefts = pa.array([None] * (n - 1) + [held] if held else [None] * n, pa.list_(piece))
    return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int64()), lefts], names=[k for k, _ in kinds] + ["part", "left"])


def _first(level: int, part: int) -> int:
    """The number of the first window that a task makes: tasks of all levels have numbers of their own."""
    return level << 56 | part << 32


def tokenizing_packer(vocabulary, length: int, most: int, cut: bool, end_id: int):
    """A task's documents, tokenized and packed one after the other."""

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, packer, number, kind, held = encoding(vocabulary.value).encode_to_numpy, Packer(length, most, cut), _first(0, part), None, 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or "", allowed_special="all"), np.uint32(end_id)).astype("<u4")
                packer.place((doc, 0, ids, len(ids)))
                held += len(ids)
                if held >= BATCH_IDS:
                    yield _batch(packer.full, number, [], part, kind)
                    number, packer.full, held = number + len(packer.full), [], 0
        if kind is not None:
            left = packer.merge_leftovers()
            yield _batch(packer.full, number, left, part, kind)

    return pack_all


def leftover_packer(level: int, length: int, cut: bool, last: bool, fan_in: int):
    """Leftover windows of up to ``fan_in`` tasks become full ones and one leftover; the last of all is split into powers of two."""

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        kind = rows.schema.field("left").type.value_type.field("doc_id").type
        packer = Packer(length, fan_in, cut)
        for row in rows.sort_by("part").column("left").to_pylist():
            packer.opened += 1
            packer.windows[packer.opened] = [(p["doc_id"], p["start"], np.frombuffer(p["ids"], "<u4"), p["doc_tokens"]) for p in row]
            insort(packer.spaces, (length - sum(p["length"] for p in row), packer.opened))
        left = packer.merge_leftovers()
        done = packer.full
        if last:
            done, left = done + (powers_of_two(left) if cut else [left] * bool(left)), []
        return pa.Table.from_batches([_batch(done, _first(level, group), left, group, kind)])

    return merge


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, open_windows: int = 64, cut: bool = True, end_id: int = 1, fan_in: int = FAN_IN,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents, each with its place in a sequence.

    A document is its text's ids under the byte-level BPE file ``tokenizer`` (special strings included, as its library reads them) and
    ``end_id``. Whole sequences of a long document stand alone; what remains is packed online: a task keeps ``open_windows`` windows open, puts
    each piece where the least space holds it, and where none fits lets the fullest leave, filled with the head of the piece
    (``cut=False``: padded, pieces stay whole). At its end a task merges its open windows to one, and these leftovers are merged by
    ``fan_in`` at a time, level by level. The very last window is split into powers of two, so with ``cut`` no sequence needs padding.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` counts the document's ids before the piece, ``offset`` the sequence's.
    A task holds one document and its windows; a leftover is below ``length`` ids. Pieces are packed in the order of the table's files, so the
    same files give the same sequences.

    A null text is an empty one: its document is ``end_id`` alone. Rows with null or repeated ids are packed each for itself. Long texts
    become many sequences. Other columns are ignored, whatever they are called. An empty table gives no rows."""
    if length < 1 or length & (length - 1) or open_windows < 1 or fan_in < 2:
        raise ValueError("length is a power of two, open_windows at least 1, fan_in at least 2")
    rows, names = seal(docs)
    spark = docs.sparkSession
    read = rows.select(F.col(sealed_column(names, id_column)).alias("doc_id"), F.col(sealed_column(names, text_column)).cast("string").alias("text"))
    kind = T.StructType([read.schema["doc_id"], *T.StructType.fromDDL(PIECE)])
    schema = T.StructType([*kind, *T.StructType.fromDDL("sequence_id long, offset long, part long"), T.StructField("left", T.ArrayType(kind))])
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(tokenizer))  # as large as the vocabulary file
    packed = written(read.mapInArrow(tokenizing_packer(vocabulary, length, open_windows, cut, end_id), schema))
    levels, level = [packed], 0
    while True:
        left = levels[-1].where("left is not null")
        highest = left.agg(F.max("part")).first()[0]
        if highest is None:
            break
        level += 1
        group = F.floor(F.col("part") / fan_in).cast("long")
        merge = leftover_packer(level, length, cut, highest < fan_in, fan_in)
        levels.append(written(left.groupBy(group.alias("group")).applyInArrow(merge, schema)))
    pieces = [x.where("left is null").drop("part", "left") for x in levels]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out
