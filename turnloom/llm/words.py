"""Words of a column of texts, found on its UTF-8 bytes at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at once, so that memory doesn't follow the batch; a longer text is taken alone.
GROUP = 8 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


class Words(NamedTuple):
    """``words`` of all texts, one after the other; ``text``: the number of each one's text; ``apart``: whether a separator
    of the second kind, or another text, lies between a word and the one before."""

    words: pa.LargeStringArray
    text: np.ndarray
    apart: np.ndarray


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    c = column.cast(pa.large_string())
    if not len(c):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)


def _table(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


def split(column: pa.Array, spaces: bytes = SPACES, stops: bytes = b"", lower: bool = False) -> Words:
    """Words are the longest stretches without ``spaces`` and ``stops`` (ASCII bytes). ``lower``: A-Z become a-z."""
    at, data = _bytes(column)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~_table(spaces + stops)[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = at[:-1][np.diff(at) > 0]  # a text's first byte begins a word of its own
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    text = np.searchsorted(at, starts, "right") - 1
    apart = np.ones(len(starts), bool)
    apart[1:] = text[1:] != text[:-1]
    if stops and len(starts):
        passed = np.cumsum(_table(stops)[data])[starts]
        apart[1:] |= passed[1:] != passed[:-1]
    taken = np.cumsum(inside)
    offsets = np.r_[taken[starts] - 1, taken[-1:]] if len(starts) else np.zeros(1, np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside]))
    return Words(words, text, apart)


def groups(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``size`` bytes, one row at least."""
    for b in batches:
        n = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(n, size + (n[at - 1] if at else 0))))
            yield b.slice(at, end - at)
            at = end
