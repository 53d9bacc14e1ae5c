"""Vectorised text primitives over Arrow string columns.

A record batch's strings are one byte buffer with row offsets.  The helpers here
find words, lines and n-grams of *all* rows of a bounded slice of that buffer with
numpy, so that per-row Python never touches whole texts.  Hashes are 64-bit and
depend on bytes only, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once inside a task; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF93
_INV = pow(_BASE, -1, 1 << 64)


def mix64(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse mod 2**64 for i < n; grown by doubling, kept per worker."""
    while len(_POWERS[0]) < n:
        for k, base in ((0, _BASE), (1, _INV)):
            have = _POWERS[k]
            _POWERS[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def byte_class(excluded: str) -> np.ndarray:
    """Table byte -> True where a byte may stand in a word; every byte >= 0x80 may."""
    table = np.ones(256, bool)
    table[[ord(c) for c in excluded]] = False
    return table


#: [^\x20\x09-\x0D]+
SPACE_WORDS = byte_class(" \t\n\v\f\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased first.
ALNUM_WORDS = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 for b in range(256)])


class Slice:
    """Rows [first, last) of a string column: their bytes, and where each row begins and ends."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.n = len(bounds) - 1
        self._prefix: dict[bool, np.ndarray] = {}

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each row."""
        return segment_sums(flags, self.bounds)

    def span_hash(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of the bytes [start, end) for arrays of spans."""
        if lower not in self._prefix:
            power, _ = _powers(len(self.data) + 1)
            prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_CODES[lower][self.data] * power[:-1], out=prefix[1:])
            self._prefix[lower] = prefix
        prefix = self._prefix[lower]
        _, inverse = _powers(len(self.data) + 1)
        raw = (prefix[end] - prefix[start]) * inverse[start]
        return mix64(raw + (end - start).astype(np.uint64) * _ODD)

    def words(self, table: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
        inside = table[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = self.bounds[1:-1]
        at = edges[edges < len(self.data)]
        begins[at] |= inside[at]
        at = edges[edges > 0] - 1
        ends[at] |= inside[at]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        rows = np.searchsorted(start, self.bounds)
        return Words(start, end, rows, self.span_hash(start, end, lower) if hashed else None)


class Words:
    """All words of a slice in order; words [rows[i], rows[i+1]) belong to row i."""

    def __init__(self, start: np.ndarray, end: np.ndarray, rows: np.ndarray, hashes: np.ndarray | None):
        self.start, self.end, self.rows, self.hash = start, end, rows, hashes
        self.count = np.diff(rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of `width` words at each word, and whether the window ends inside its row."""
        n = len(self.start)
        out = np.zeros(n, np.uint64)
        fits = np.zeros(n, bool)
        if n >= width:
            m = n - width + 1
            for k in range(width):
                out[:m] = out[:m] * np.uint64(_BASE) + self.hash[k : k + m]
            last = np.repeat(self.rows[1:], self.count)
            fits[:m] = np.arange(m) + width <= last[:m]
        return mix64(out), fits


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:], dtype=kind)
    return total[bounds[1:]] - total[bounds[:-1]]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about `limit` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def hash_word(word: bytes, lower: bool = False) -> int:
    """The hash that Slice.words gives a word."""
    return int(hash_words([word], lower)[0])


def hash_words(words: list[bytes], lower: bool = False) -> np.ndarray:
    """Hashes, as Slice.words gives them, of words that stand alone."""
    ends = np.cumsum([0, *(len(w) for w in words)]).astype(np.int64)
    whole = Slice(0, np.frombuffer(b"".join(words), np.uint8), ends)
    return whole.span_hash(ends[:-1], ends[1:], lower)


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
