"""Vectorised word and window hashing over Arrow string columns.

Works on the UTF-8 buffer of a batch, so no Python object is made per word.  Hashes are stable
across processes and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes worked on at a time; bounds the temporary arrays of byte-wise steps (about 40 bytes for each), also inside a longer text.
SLICE_BYTES = 1_000_000

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_B, _B_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a longer text has a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


@dataclass
class Words:
    start: np.ndarray  # byte offsets in the slice
    end: np.ndarray
    first: np.ndarray  # words[first[d]:first[d + 1]] belong to document d
    hash: np.ndarray

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross document borders: (starts, ends, first run of each document)."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < n)]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[borders - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, which ascend and don't overlap.

    Worked on in slices; a span longer than a slice is hashed as the sequence of its pieces, wherever it stands.
    """
    if len(data) <= SLICE_BYTES:
        return _slice_hashes(data, starts, ends)
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a, b = int(starts[i]), int(ends[i])
        if b - a > SLICE_BYTES:
            cuts = np.append(np.arange(a, b, SLICE_BYTES), b)
            h = np.uint64(b - a)
            for x, y in zip(cuts, cuts[1:]):
                h = mix(np.array([h]) * _B + _slice_hashes(data[x:y], np.array([0]), np.array([y - x])))[0]
            out[i] = h
            i += 1
            continue
        j = int(np.searchsorted(ends, a + SLICE_BYTES, "right"))
        out[i:j] = _slice_hashes(data[a : int(ends[j - 1])], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def _slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Differences of a prefix polynomial, brought to a common power, then mixed."""
    power, inverse = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    starts, ends, first = runs(is_word[data], offsets)
    return Words(starts, ends, first, span_hashes(data, starts, ends))


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of all windows of `size` words inside documents."""
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(w.first[1:], np.diff(w.first))[: n - size + 1]
    at = np.arange(n - size + 1)
    at = at[at + size <= last]
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = mix(h * _B + w.hash[at + j] + np.uint64(j + 1))
    return at, h


def table256(chars: bytes, inside: bool = True) -> np.ndarray:
    out = np.full(256, not inside)
    out[list(chars)] = inside
    return out


#: Words of the class [^\x20\x09-\x0D]+ and the translation of A-Z to lower case.
NOT_SPACE = table256(b" \t\n\x0b\x0c\r", inside=False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
