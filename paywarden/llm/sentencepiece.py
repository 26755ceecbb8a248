"""SentencePiece encoding and decoding over a published model file.

An Aho-Corasick automaton over the pieces reads a text once; at every position
its output links give all pieces that end there, and each of them relaxes the
best way to reach that position. In a unigram model the best way has the
largest sum of scores. A BPE model has no sums: its merge order decides. There
a step is open only between two pieces that the merges would leave apart;
every position then has exactly one way in, the one the merges lead to.

Text is split where no piece crosses: before runs of the space mark, and between
characters that stand next to each other in no piece. Ways of short splits are
kept for reuse by a worker. Characters outside the pieces become byte pieces or, without
those, the unknown piece.

Defined cases: a null or empty text has no tokens and decodes to an empty text;
the mark U+2581 itself reads back as a space, as the format has it; repeated
rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from paywarden.llm.common import give_back

#: Fixed values of the format: the space mark, piece types, and the penalty of an unknown character.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Ways that a worker keeps, the longest split it keeps, and pairs of pieces it remembers.
KEPT, LONGEST, PAIRS = 300_000, 48, 500_000
#: What stands before the first piece of a split.
START = (1 << 31) - 1


class Ways(dict):
    """Piece ids by split, as bytes. When full, it becomes the old generation, from which what is used again returns."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, split: str) -> bytes:
        ids = self.old.get(split) or np.array(self.encode(split), np.int32).tobytes()
        if len(split) <= LONGEST:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[split] = ids
        return ids


def split_pattern(pieces) -> str:
    """A pattern of the parts of a text that no piece crosses.

    Characters that stand next to each other in some piece belong together; a
    part is a run of such characters with the marks before it.
    """
    if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
        return "(?s).+"
    group: dict[str, set[str]] = {}
    for piece in pieces:
        own = set(piece) - {MARK}
        if len(piece.lstrip(MARK)) < 2:
            continue
        merged = own.union(*(group[c] for c in own if c in group))
        group.update(dict.fromkeys(merged, merged))
    runs = {id(chars): chars for chars in group.values()}.values()
    classes = ["[" + "".join(map(re.escape, sorted(chars))) + "]+" for chars in sorted(runs, key=len, reverse=True)]
    return f"(?s){MARK}*(?:{'|'.join([*classes, f'[^{MARK}]'])})|{MARK}+"


class Tokenizer:
    """One model: its pieces, the automaton over them, and both directions."""

    def __init__(self, model: bytes):
        spec = proto.ModelProto.FromString(model)
        kind, norm = spec.trainer_spec.model_type, spec.normalizer_spec
        if kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("Only unigram and BPE models without text normalisation are read.")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in spec.pieces):
            raise ValueError("User-defined and unused pieces are not read.")
        self.merges = kind == BPE
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.pieces = [p.piece for p in spec.pieces]
        self.worth = [p.score for p in spec.pieces]
        self.characters = {p.piece for p in spec.pieces if p.type == NORMAL and len(p.piece) == 1}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.unknown_score = min(self.score.values()) - UNKNOWN_PENALTY
        self.raw = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" if p.type == CONTROL
            else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()
            for p in spec.pieces
        ]
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(spec.pieces):
            if p.type == NORMAL:
                self.automaton.add_word(p.piece, (i, len(p.piece)))
        self.automaton.make_automaton()
        self.splits = re.compile(split_pattern(self.score)).findall
        self.apart: dict[int, bool] = {}
        self.ways = Ways(self.best_way)

    def merged(self, text: str) -> list[str]:
        """A short text after all merges, the best-scored adjacent pair first."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges of two pieces' text end in just these two; left is START at the beginning."""
        after = self.pieces[right]
        before = "" if left == START else self.pieces[left]
        known = left == self.unknown or self.merged(before + after) == ([before, after] if before else [after])
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[left << 32 | right] = known
        return known

    def relaxed_by_merges(self, split: str, start: list[int], piece: list[int]) -> None:
        """A position's way in is the longest piece that stays apart from the piece before it."""
        apart, stay_apart, strange = self.apart.get, self.stay_apart, self.strange(split)
        for end, (i, length) in self.automaton.iter(split):
            if strange and strange[0] < end:
                self.stand_alone(strange, end, start, piece)
            begin = end + 1 - length
            left = piece[begin]
            if left >= 0 > piece[end + 1]:
                known = apart(left << 32 | i)
                if stay_apart(left, i) if known is None else known:
                    piece[end + 1], start[end + 1] = i, begin
        self.stand_alone(strange, len(split), start, piece)

    def relaxed_by_scores(self, split: str, start: list[int], piece: list[int]) -> None:
        """A position's way in is the piece with the best sum of scores up to it."""
        best, strange = [0.0] + [-np.inf] * len(split), self.strange(split)
        for end, (i, length) in chain(self.automaton.iter(split), [(len(split), (0, 0))]):
            for at in self.stand_alone(strange, end, start, piece):
                best[at + 1] = best[at] + self.unknown_score
            begin, to = end + 1 - length, end + 1
            if length and best[begin] + self.worth[i] > best[to]:
                best[to], piece[to], start[to] = best[begin] + self.worth[i], i, begin

    def strange(self, split: str) -> list[int]:
        """Places of characters outside the pieces."""
        return [] if self.characters.issuperset(split) else [at for at, c in enumerate(split) if c not in self.characters]

    def stand_alone(self, strange: list[int], end: int, start: list[int], piece: list[int]) -> list[int]:
        """Characters outside the pieces before ``end`` that no piece covers stand alone; returns their places."""
        alone = []
        while strange and strange[0] < end:
            at = strange.pop(0)
            if piece[at + 1] < 0 <= piece[at]:
                piece[at + 1], start[at + 1] = self.unknown, at
                alone.append(at)
        return alone

    def best_way(self, split: str) -> list[int]:
        """Viterbi over one split: at every position the pieces that end there relax the best way in, longest first."""
        start, piece = [0] * (len(split) + 1), [START] + [-1] * len(split)
        (self.relaxed_by_merges if self.merges else self.relaxed_by_scores)(split, start, piece)
        ids: list[int] = []
        at = len(split)
        while at:
            begin, i = start[at], piece[at]
            if i == self.unknown and self.bytes:
                ids += [self.bytes[b] for b in reversed(split[begin:at].encode("utf-8"))]
            else:
                ids.append(i)
            at = begin
        return ids[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        splits = self.splits(self.prefix + text.replace(" ", MARK))
        return np.frombuffer(b"".join(map(self.ways.__getitem__, splits)), np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def tokenizer(model: bytes) -> Tokenizer:
    """One tokenizer per worker and model."""
    return Tokenizer(model)


ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])


def encoder(spark: SparkSession, path: str):
    """text -> (piece ids, whether they decode to the text). The model file, under a megabyte, is sent once."""
    model = spark.sparkContext.broadcast(Path(path).read_bytes())

    @F.arrow_udf(ENCODED)
    def encode(texts: pa.Array) -> pa.Array:
        own = tokenizer(model.value)
        ids, exact, ends = bytearray(), [], [0]
        for text in texts:
            text = text.as_py()
            found = own.encode(text)
            ids += found.tobytes()
            ends.append(ends[-1] + len(found))
            exact.append(own.decode(found.tolist()) == (text or ""))
        give_back()
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(exact, pa.bool_())], ["ids", "exact"])

    return encode


def decoder(spark: SparkSession, path: str):
    """Piece ids -> text."""
    model = spark.sparkContext.broadcast(Path(path).read_bytes())

    @F.arrow_udf(T.StringType())
    def decode(lists: pa.Array) -> pa.Array:
        own = tokenizer(model.value)
        return pa.array([own.decode(ids.as_py() or ()) for ids in lists], pa.string())

    return decode


def encoded(docs: DataFrame, path: str, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids, and whether the ids decode to the text."""
    rows = docs.select(*keep, encoder(docs.sparkSession, path)(text).alias("_encoded"))
    return rows.select(
        *keep, F.size("_encoded.ids").alias("n_tokens"), F.col("_encoded.ids").alias("ids"),
        F.col("_encoded.exact").alias("round_trip"),
    )
