"""Token counts by dynamic programming shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import seal, sealed_column, unseal

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What a pre-token begins with in the vocabulary.
SPACE = "▁"
KNOWN = 200_000
#: Texts whose distinct words form one trie.
TOGETHER = 256


def read_pieces(path: str) -> dict[str, float]:
    """Piece to log-probability of a vocabulary file, read on the driver only.

    The file ranks its pieces by merges and has no probabilities: a piece of rank r gets that of Zipf's law, 1 / ((r + 1) H)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ranked)}


class Counter(dict):
    """Pre-token (UTF-8) to the number of pieces of its most likely segmentation."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        self.pieces = pieces
        self.ends = {p[i:] for p in pieces for i in range(len(p))}
        self.unknown = min(pieces.values(), default=0.0) - 10

    def learn(self, words: Iterable[bytes]) -> None:
        """Counts new pre-tokens. In sorted order they are the leaves of their trie as a depth-first walk meets them: the forward
        scores along the last path stay on a stack, those of a shared prefix are not computed again, and each word's last node gives its
        count. A character outside the vocabulary is spelled in bytes."""
        if len(self) > KNOWN:
            self.clear()
        pieces, ends, unknown = self.pieces, self.ends, self.unknown
        before, scores, counts = "", [0.0], [0]
        for word in sorted(set(words) - self.keys()):
            path = SPACE + word.decode("utf-8", "replace")
            shared, most = 0, min(len(before), len(path))
            while shared < most and before[shared] == path[shared]:
                shared += 1
            del scores[shared + 1:], counts[shared + 1:]
            for end in range(shared + 1, len(path) + 1):
                spelled = len(path[end - 1].encode("utf-8", "replace"))
                best, count = scores[end - 1] + unknown * spelled, counts[end - 1] + spelled
                begin = end - 1
                while begin >= 0 and (piece := path[begin:end]) in ends:
                    score = pieces.get(piece)
                    if score is not None and score + scores[begin] > best:
                        best, count = score + scores[begin], counts[begin] + 1
                    begin -= 1
                scores.append(best)
                counts.append(count)
            self[word] = counts[-1]
            before = path


def counter(pieces: dict[str, float]):
    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Counter(pieces)
        for texts in batches:
            counts: list[int] = []
            for at in range(0, len(texts), TOGETHER):
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts.iloc[at:at + TOGETHER]]
                known.learn({w for words in split for w in words})
                counts += [sum(map(known.__getitem__, words)) for words in split]
            yield pd.Series(counts, dtype="int64")

    return counted


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text_column: str = "text") -> DataFrame:
    """Adds n_tokens to every row: the pieces of the most likely segmentation of its words under a unigram model of ``vocabulary``.

    Words end at a blank or at tab to carriage return and are segmented each for itself, with a mark for the blank before. Distinct words of TOGETHER texts form
    a trie whose forward scores are computed once per shared prefix; a task remembers so many words' counts. Of equally likely
    segmentations the one with the shortest last piece counts.

    Null and empty texts have no tokens. Repeated rows are counted each. A column named n_tokens is replaced. An empty table gives no rows."""
    rows, names = seal(docs)
    counted = rows.withColumn("n_tokens", counter(read_pieces(vocabulary))(F.col(sealed_column(names, text_column))))
    return unseal(counted, names, ("n_tokens",))
