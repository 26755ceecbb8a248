"""Scores of whole texts under n-gram tables that no machine holds.

Texts are dealt into chunks of a bounded number of bytes. A chunk asks once for
each n-gram that occurs in it; the questions are joined with the sharded
tables, and the answers come back to the chunk, where they are summed by text.
What moves is the texts once and the distinct n-grams of every chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paywarden.llm.common import lean_batches
from paywarden.llm.grams import Lookup, blocks

#: Bytes of text in a chunk.
CHUNK_BYTES = 14 << 20
#: A byte that UTF-8 never has: it stands before and after every text.
EDGE = b"\xff"


def chunk_count(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(1, ceil(size / CHUNK_BYTES))


def chunk_of(count: int) -> Column:
    """The chunk of a document, by the hash of id and length."""
    return F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(count)).cast("int").alias("chunk")


def in_chunks(docs: DataFrame, count: int, *columns: str) -> DataFrame:
    """(chunk, blob): doc_id, text and further columns of the documents of a chunk.

    Every task packs its rows for a chunk into compressed blobs, which move in place of the rows.
    """
    rows = docs.select("doc_id", "text", *columns, chunk_of(count))
    return rows.mapInArrow(lean_batches(packed_by_chunk), "chunk int, blob binary").repartition(count, "chunk")


def packed_by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable")
        bounds = np.flatnonzero(np.diff(chunks[order])) + 1
        ordered = batch.drop_columns(["chunk"]).take(pa.array(order))
        for begin, end in zip([0, *bounds], [*bounds, batch.num_rows]):
            if end > begin:
                blob = packed(ordered.slice(begin, end - begin))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunks[order[begin]]], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "blob"]
                )


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(group: pa.Table) -> pa.Table:
    """The rows of a chunk's blobs."""
    return pa.concat_tables([pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in group["blob"]])


def bordered(stream: bytes, order: int) -> bytes:
    """A text between edges: as many n-grams as it has bytes, and one for its end."""
    return EDGE * (order - 1) + stream + EDGE


def distinct_grams(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of the texts and how often they have it."""
    parts = [np.unique(keys, return_counts=True) for keys, _ in blocks(streams, order)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def seen_grams(others: list[bytes], learned: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of the texts, and how often those that are learned from have it."""
    scored, _ = distinct_grams(others, order)
    known, n = distinct_grams(learned, order)
    grams = np.union1d(scored, known)
    counts = np.zeros(len(grams), np.int64)
    counts[np.searchsorted(grams, known)] = n
    return grams, counts


def summed_by_text(streams: list[bytes], order: int, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's n-grams, all of which are known."""
    total = np.zeros(len(streams))
    if len(grams):
        lookup = Lookup(grams)
        ranked = values[np.argsort(grams, kind="stable")]
        for keys, owner in blocks(streams, order):
            total += np.bincount(owner, ranked[lookup.rows(keys)], len(streams))
    return total
