"""Word spans and word hashes over Arrow string columns, in numpy.

Used inside Arrow tasks.  Texts are handled as UTF-8 bytes, a few of them at a
time (``TEXT_BYTES``), so that memory stays bounded whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TEXT_BYTES = 1 << 20
#: Hashing takes some 48 bytes for each of a window; hashes do not depend on it.
WINDOW_WORDS_BYTES = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_ODD, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start[i]:end[i]]`` for each i, equal for equal contents."""
    n = len(values)
    up, down = _POWERS.upto(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Words of some consecutive texts: byte spans, 64-bit hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, text_start: np.ndarray, text_end: np.ndarray, space: np.ndarray = _SPACE) -> None:
        self.data = data
        gap = space[data]
        first = ~gap
        last = first.copy()
        inner = first.copy()
        if len(data):
            first[1:] &= gap[:-1]
            last[:-1] &= gap[1:]
            inside = text_start[(text_start > 0) & (text_start < len(data))]
            first[inside] = inner[inside]
            last[inside - 1] = inner[inside - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.begin = np.searchsorted(self.start, text_start)
        self.stop = np.searchsorted(self.start, text_end)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + WINDOW_WORDS_BYTES)))
            lo, hi = self.start[i], self.end[j - 1]
            out[i:j] = range_hashes(self.data[lo:hi] + np.uint64(1), self.start[i:j] - lo, self.end[i:j] - lo)
            i = j
        return out


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of rows of a string column: first row, end row, bytes, start and end of each text in them.

    A group holds about TEXT_BYTES, and one text at least; nulls are empty.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, offsets, data = chunk.buffers()
        if len(chunk) == 0:
            continue
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(at, at[i] + TEXT_BYTES, side="right")) - 1)
            yield row + i, row + j, raw[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]
            i = j
        row += len(chunk)
