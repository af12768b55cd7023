"""Words of many texts at once: NumPy over the UTF-8 bytes of an Arrow column.

A word's hash is a difference of prefix sums of ``byte * M**position``, scaled back to
position 0, so that all words of a block cost a few array operations per byte and no
Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

#: Bytes handled at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def _powers(name: str, base: int, size: int) -> np.ndarray:
    held = _POWERS.get(name)
    if held is None or len(held) < size:
        held = np.full(max(size, BLOCK_BYTES + 1), base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _POWERS[name] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(kept) -> np.ndarray:
    """True for bytes of words."""
    return np.array([bool(kept(b)) for b in range(256)])


NOT_SPACE = byte_table(lambda b: b not in SPACES)
LETTERS = byte_table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        lengths = np.where(np.asarray(column.is_valid()), np.diff(places), 0)
        if lengths.sum() != places[-1] - places[0]:
            return column_bytes(column.fill_null(""))
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), places


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of at most ``limit`` bytes."""
    data, places = column_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(places, places[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[places[lo] : places[hi]], places[lo : hi + 1] - places[lo]
        lo = hi


def span_hasher(data: np.ndarray):
    """A function from byte ranges (starts, ends) of ``data`` to their 64-bit hashes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n)[:n], out=sums[1:])
    down = _powers("down", _INVERSE, n + 1)
    return lambda start, end: mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """Word bounds and hashes of a block of texts.

    ``start``/``end`` are byte positions, ``bounds[d]:bounds[d + 1]`` the words of text d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = kept[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True  # no word crosses a text's end
        before = np.concatenate(([False], inside[:-1])) & ~cut[:-1] if n else inside
        after = np.concatenate((inside[1:], [False])) & ~cut[1:] if n else inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self._span = span_hasher(self.data)

    def hashes(self) -> np.ndarray:
        return self._span(self.start, self.end)

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes; 0 for words that are not longer."""
        out = self._span(self.start, np.minimum(self.start + size, self.end)) ^ np.uint64(size)
        return np.where(self.end - self.start > size, out, np.uint64(0))

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def owners(counts: np.ndarray) -> np.ndarray:
    """The text number of each word, from the words per text."""
    return np.repeat(np.arange(len(counts)), counts)
