"""Byte n-grams of many texts at once, as whole numbers in NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes that are looked at together: bounds the arrays whatever the texts' lengths.
BLOCK = 1 << 20


def packed(data: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that starts at each byte, up to 7 bytes in a 64-bit number."""
    count = max(len(data) - order + 1, 0)
    keys = data[:count].astype(np.int64)
    for step in range(1, order):
        keys <<= 8
        keys |= data[step:step + count]
    return keys


def joined(streams: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All streams behind each other, and where each one begins (and the last one ends)."""
    starts = np.zeros(len(streams) + 1, np.int64)
    np.cumsum([len(s) for s in streams], out=starts[1:])
    return np.frombuffer(b"".join(streams), np.uint8), starts


def blocks(streams: Sequence[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, index of the stream of each), a block at a time; none crosses two streams."""
    data, starts = joined(streams)
    for begin in range(0, max(len(data) - order + 1, 0), BLOCK):
        keys = packed(data[begin:begin + BLOCK + order - 1], order)
        end = begin + len(keys)
        first, last = np.searchsorted(starts, [begin, end - 1], side="right") - 1
        texts = np.arange(first, last + 1)
        # The block's n-grams of a text: from its start, or the block's, to the last one that ends in the text.
        since = np.maximum(starts[texts], begin)
        until = np.maximum(np.minimum(starts[texts + 1] - order + 1, end), since)
        inside, counts = np.zeros(len(keys), bool), until - since
        for here, there in zip((since - begin).tolist(), (until - begin).tolist()):
            inside[here:there] = True
        yield keys[inside], np.repeat(texts, counts)


class Lookup:
    """Row numbers of known keys, by two hash tables and a search for the few that collide in both."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = max(int(len(keys)).bit_length() + 2, 10)
        self.tables = []
        rest = np.arange(len(self.keys))
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            table = np.full(1 << self.bits, -1, np.int32)
            slots = self.slots(self.keys[rest], factor)
            count = np.bincount(slots, minlength=len(table))
            table[slots] = rest
            table[count > 1] = -1
            self.tables.append((factor, table))
            rest = rest[count[slots] > 1]

    def slots(self, keys: np.ndarray, factor: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - self.bits)).view(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row in ``keys`` (sorted) of each key; every key must be known."""
        (first, table), (second, other) = self.tables
        found = table[self.slots(keys, first)]
        missed = np.flatnonzero(found < 0)
        if len(missed):
            found[missed] = other[self.slots(keys[missed], second)]
            missed = missed[found[missed] < 0]
            found[missed] = np.searchsorted(self.keys, keys[missed])
        return found
