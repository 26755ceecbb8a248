"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash has enough
zero bits, more of them before the normal size than after it, so that sizes
gather around the normal one. An edit moves only the boundaries near it. The
fingerprint of a text is the set of its chunks' digests with their lengths;
the share of a fingerprint's length whose chunks another one has too measures
how far the other contains it.

Defined cases: a null text is an empty one, whose fingerprint is empty; two
empty fingerprints are alike (1), an empty and another one are not (0);
repeated rows and equal texts have equal fingerprints; a null id comes after
all others; of rows with one id the least text counts as the next document; a
table of one id has itself as next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from paywarden.llm.common import running, shuffle_partitions, utf8, written
from paywarden.llm.shards import CHUNK_BYTES

#: Chunk sizes in bytes: least, normal, most; zero bits asked for before and after the normal size.
LEAST, NORMAL, MOST = 16, 64, 256
STRICT, LOOSE = 7, 5
#: Bytes hashed at a time; rows and characters of fingerprints that leave a task together; bytes that a row counts besides its text.
BLOCK, BATCH_ROWS, BATCH_CHARS, ROW_BYTES = 1 << 20, 512, 8 << 20, 64
#: The hash of a byte: 256 numbers of 32 bits, made by a rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: a byte counts for 32 steps, then its bits have moved out."""
    rolled = GEAR[data]
    reach = 1
    while reach < 32:
        ahead = rolled.copy()
        ahead[reach:] += rolled[:-reach] << np.uint32(reach)
        rolled, reach = ahead, 2 * reach
    return rolled


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    data, strict, loose = np.frombuffer(raw, np.uint8), [], []
    for begin in range(0, len(data), BLOCK):
        back = min(begin, 31)
        rolled = gear(data[begin - back:begin + BLOCK])[back:]
        zeros = np.flatnonzero(rolled >> np.uint32(32 - LOOSE) == 0)
        loose.append(zeros + begin + 1)
        strict.append(zeros[rolled[zeros] >> np.uint32(32 - STRICT) == 0] + begin + 1)
    ends, size = [], len(raw)
    hard = np.concatenate(strict).tolist() + [size + MOST] if strict else []
    soft = np.concatenate(loose).tolist() + [size + MOST] if loose else []
    start = i = j = 0
    while start < size:
        while hard[i] < start + LEAST:
            i += 1
        end = hard[i]
        if end > start + NORMAL:
            while soft[j] <= start + NORMAL:
                j += 1
            end = min(soft[j], start + MOST)
        start = min(end, size)
        ends.append(start)
    return ends


def fingerprint(raw: bytes) -> dict[int, int]:
    """Digest of every distinct chunk with its length."""
    start, found = 0, {}
    for end in boundaries(raw):
        found[xxhash.xxh3_64_intdigest(raw[start:end])] = end - start
        start = end
    return found


def as_text(chunks: dict[int, int]) -> str:
    """Digests in order, each with the chunk's length."""
    return " ".join(f"{digest:016x}:{length}" for digest, length in sorted(chunks.items()))


def containment(chunks: dict[int, int], other: dict[int, int]) -> float:
    """The share of the first fingerprint's length that the other one has too."""
    total = sum(chunks.values())
    if not total:
        return 0.0 if other else 1.0
    return sum(length for digest, length in chunks.items() if digest in other) / total


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
LAYOUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compared(rows: Iterator[tuple]) -> Iterator[dict]:
    """Rows of (group, carried, doc_id, text) in ascending order, each against the next document in descending order.

    A group's first row carries the text that its least id is compared with; the first row of an id has its least text.
    So no more than the texts of a row and of the two documents around it are held.
    """
    now, least, after = None, ("", {}), ("", {})
    for group, carried, doc_id, text in rows:
        text = text or ""
        own = fingerprint(utf8(text))
        if carried:
            now, least = None, (text, own)
            continue
        if now != (group, doc_id):
            now, after, least = (group, doc_id), least, (text, own)
        changed = utf8(edited(text, after[0]))
        other = fingerprint(changed)
        yield {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed).hexdigest(),
            "fingerprint": as_text(own), "edited_fingerprint": as_text(other),
            "near_edited": containment(own, other), "near_next": containment(own, after[1]),
        }


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = (
        (group, not place, doc_id, text.as_py()) for batch in batches
        for group, place, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("group", "place", "doc_id")), batch.column("text"))
    )
    rows, size = [], 0
    for row in compared(every):
        rows.append(row)
        size += len(row["fingerprint"]) + len(row["edited_fingerprint"])
        if len(rows) == BATCH_ROWS or size > BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(rows, schema=ROW)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=ROW)


def ranges(docs: DataFrame) -> list[tuple[int | None, int]]:
    """(largest id, number of groups) of ranges of ids of like bytes, in ascending order with a null id first.

    There are as many as shuffle partitions, and more if a range would exceed a chunk. An id that exceeds a range is a
    range of its own, whose rows are dealt to several groups.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + ROW_BYTES
    sizes = written(docs.groupBy("doc_id").agg(F.sum(size).alias("size")), "ids")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    most = max(1, min(CHUNK_BYTES, -(-total // shuffle_partitions(docs.sparkSession))))
    up = [F.col("doc_id").asc_nulls_first()]
    upto = running(sizes, [], up, up, F.sum, Column.__add__, upto="size")
    large = F.col("size") > most
    # What exceeds a range begins in it last.
    place = 2 * F.floor((F.col("upto") - F.col("size")) / most) + large.cast("bigint")
    found = upto.groupBy(place.alias("place")).agg(F.max("doc_id").alias("head"), F.max("size").alias("size")).collect()
    return [(r["head"], -(-r["size"] // most)) for r in sorted(found, key=lambda r: r["place"])]


def grouper(found: list[tuple[int | None, int]]):
    """(id, draw) -> number of its group; a null id belongs to the lowest range."""
    first = np.cumsum([0, *(n for _, n in found)])[:-1].astype(np.int32)
    parts = np.array([n for _, n in found], np.int64)
    skipped = sum(head is None for head, _ in found)
    limits = np.array([head for head, _ in found if head is not None], np.int64)

    @F.arrow_udf(T.IntegerType())
    def place(ids: pa.Array, draws: pa.Array) -> pa.Array:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(limits, known, side="left") + skipped)
        return pa.array((first[at] + draws.to_numpy() % parts[at]).astype(np.int32), pa.int32())

    return place


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like they are and the next document's.

    Texts move once, by groups of ids of like bytes, and are read in order, one at a time. The least text of a range's
    largest id also goes to the groups of the range above, whose least id it follows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = ranges(rows)
    if not found:
        return docs.sparkSession.createDataFrame([], LAYOUT)
    count, heads, group = sum(n for _, n in found), [], 0
    for (_, n), (below, _) in zip(found, found[-1:] + found[:-1]):
        heads += [(below, group + i) for i in range(n)]
        group += n
    heads = docs.sparkSession.createDataFrame(heads, "head bigint, group int")
    same = F.col("doc_id").eqNullSafe(F.col("head"))
    wanted = rows.join(F.broadcast(heads.select("head").distinct()), same, "left_semi")
    least = wanted.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    carried = least.join(F.broadcast(heads), same).select("group", F.lit(0).alias("place"), "doc_id", "text")
    draw = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)) if count > len(found) else F.lit(0).cast("bigint")
    drawn = rows.withColumn("draw", draw)
    dealt = drawn.select(grouper(found)("doc_id", "draw").alias("group"), F.lit(1).alias("place"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = dealt.unionByName(carried).repartition(count, "group").sortWithinPartitions(
        "group", "place", F.col("doc_id").asc_nulls_first(), "text"
    )
    return ordered.mapInArrow(in_order, LAYOUT)
