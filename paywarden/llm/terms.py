"""Words of digits, letters a-z and characters beyond ASCII, with A-Z in lower case, as UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

from paywarden.llm.common import utf8

#: Bytes of text that are cut into words at a time.
BLOCK = 1 << 20
#: Every byte that no word holds becomes a space; the bytes of characters beyond ASCII stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, a block of it at a time, so that a very long text is never one list."""
    stream = utf8(text).translate(WORD_BYTES)
    begin = 0
    while begin < len(stream):
        end = stream.find(b" ", begin + BLOCK)
        end = len(stream) if end < 0 else end
        yield stream[begin:end].split()
        begin = end
