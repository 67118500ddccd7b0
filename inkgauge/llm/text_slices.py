"""Words of very long texts, a slice at a time, and their numbers."""

from __future__ import annotations

from collections.abc import Iterator

SLICE = 1 << 20
_BLANK = b" \t\n\x0b\x0c\r"


def lower_words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, A-Z in lower case, in lists that cover about a megabyte of text each.

    ``bytes`` knows exactly the six white-space characters that separate words here.
    """
    if len(data) <= SLICE:
        yield data.lower().split()
        return
    begin = 0
    while begin < len(data):
        end = min(begin + SLICE, len(data))
        while end < len(data) and data[end] not in _BLANK:
            end += 1
        yield data[begin:end].lower().split()
        begin = end
