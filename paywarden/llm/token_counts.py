"""How many tokens a public tokenizer makes of every text.

An Arrow function takes the texts of a batch and returns lengths only. Long
texts are cut into parts where no token can reach over the cut, parts are
gathered into batches of like bytes, and the tokenizer's library encodes a batch
at a time; ids never leave the function.

Where a cut is safe: a SentencePiece model joins two neighbours only if their
text is in a piece, so two characters that stand next to each other in no piece
always part. At a space that follows such a character, the rest of the text
starts over as a text of its own, because the model puts a space before every
text anyway. Before any other character that joins neither the one before it nor
a space, the rest counts one token less, the space. Vocabularies of the other
library are cut before a space between two ASCII letters, if their words end
there. A stretch without a safe cut is encoded whole.

Defined cases: null counts as empty, an empty text has no tokens; repeated rows
and rows without id are counted each; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of a part before the next safe cut is looked for, and of a batch.
PART, BATCH = 1 << 16, 1 << 20
#: Fixed value: the sign that SentencePiece writes for a space.
MARK = "▁"


class Pieces:
    """Counts of a SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = own = sentencepiece.SentencePieceProcessor(model_proto=model)
        kinds = [(own.is_control(i) or own.is_unknown(i) or own.is_byte(i), own.id_to_piece(i)) for i in range(own.get_piece_size())]
        pieces = [piece for special, piece in kinds if not special]
        self.joined = {a + b for piece in pieces for a, b in zip(piece, piece[1:])}
        #: Texts are taken as they are, with a space before them; no other model is cut.
        self.plain = own.normalize("a  ﬁ①e\u0301 ") == f"{MARK}a{MARK}{MARK}ﬁ①e\u0301{MARK}"
        #: A space on its own is one token, and characters outside the pieces never run together.
        self.lone = MARK in pieces and any(own.is_byte(i) for i in range(own.get_piece_size()))

    def cut(self, text: str, begin: int) -> tuple[int, int, int]:
        """(end of the part, begin of the rest, tokens that the rest counts too many) for the next safe cut."""
        for at in range(begin, len(text) if self.plain else 0):
            before, here = text[at - 1].replace(" ", MARK), text[at].replace(" ", MARK)
            if before + here not in self.joined:
                if text[at] == " " and at + 1 < len(text):
                    return at, at + 1, 0
                if self.lone and here != MARK and MARK + here not in self.joined:
                    return at, at, 1
        return len(text), len(text), 0

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(parts, num_threads=1)]


class Words:
    """Counts of a vocabulary in the format of the tokenizers library."""

    LETTERS = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode("utf-8"))
        self.library.no_truncation()
        self.library.no_padding()
        splitter = self.library.pre_tokenizer
        self.plain = splitter is not None and len(splitter.pre_tokenize_str("a a")) > 1

    def cut(self, text: str, begin: int) -> tuple[int, int, int]:
        found = self.LETTERS.search(text, begin) if self.plain else None
        at = found.start() if found else len(text)
        return at, at, 0

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(found) for found in self.library.encode_batch(parts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def counter(model: bytes, kind: str) -> Pieces | Words:
    """One counter per worker and model."""
    return Pieces(model) if kind == ".model" else Words(model)


def parts_of(text: str, own: Pieces | Words, part: int) -> Iterator[tuple[str, int]]:
    """The text in parts, each with the tokens that it counts too many."""
    begin = more = 0
    while len(text) - begin > part:
        end, rest, extra = own.cut(text, begin + part)
        yield text[begin:end], more
        begin, more = rest, extra
    if begin < len(text):
        yield text[begin:], more


def lengths(texts, own: Pieces | Words, part: int = PART, batch: int = BATCH) -> np.ndarray:
    """Tokens of each text."""
    found = np.zeros(len(texts), np.int64)
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def count() -> None:
        np.add.at(found, owners, own.lengths(held))

    for at, text in enumerate(texts):
        for piece, more in parts_of(text.as_py() or "", own, part):
            found[at] -= more
            held.append(piece)
            owners.append(at)
            size += len(piece)
            if size >= batch:
                count()
                held, owners, size = [], [], 0
    if held:
        count()
    return found


def token_counter(spark: SparkSession, path: str):
    """text -> number of tokens. The model file, a few megabytes, is sent once; its suffix names its library."""
    file = Path(path)
    if file.suffix not in (".model", ".json"):
        raise ValueError(f"No library reads {file.name}: a .model or .json file is needed.")
    model, kind = spark.sparkContext.broadcast(file.read_bytes()), file.suffix

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(lengths(texts, counter(model.value, kind)), pa.int64())

    return count


def counted(docs: DataFrame, path: str, limit: int, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes (UTF-8), n_tokens, and whether there are more tokens than the limit."""
    whole = F.col(text) if isinstance(text, str) else text
    rows = docs.select(*keep, F.coalesce(F.octet_length(whole), F.lit(0)).cast("long").alias("n_bytes"),
                       token_counter(docs.sparkSession, path)(whole).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
