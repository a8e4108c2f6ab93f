"""Vectorised byte-level text kernels shared by the operators of this package.

Everything works on the buffers of an Arrow string column: no Python object is made per
word. A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; those bytes
never occur inside a multi-byte UTF-8 sequence, so byte-level splitting is exact.

Hashes are 64 bits: spans are read in lanes of eight bytes, each lane mixed in by a bijection (so
spans of one length up to eight bytes never share a hash), long ones by xxh3; windows join the
hashes of shorter runs. All is fixed, so every executor and every run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U64 = np.uint64
#: Bytes of text that one vectorised step handles; a single longer document is a step of its own.
CHUNK_BYTES = (2 << 20) - 64


def splitmix(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers by the public SplitMix64 rule."""
    with np.errstate(over="ignore"):
        z = U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    """Avalanche finish (SplitMix64): every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


#: Spans over this many bytes are hashed one by one; shorter ones in lanes of eight bytes, all at once.
LONG = 64
_LANE = U64(0xA0761D6478BD642F)
_JOIN = U64(0xD1342543DE82EF93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on, as one number; the last eight places have none."""
    return np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,)) if len(data) else np.empty(0, U64)


def padded(data: np.ndarray) -> np.ndarray:
    """``data`` with the spare bytes that the lanes of its last places read."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, seed: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span of ``data``; equal bytes give equal hashes wherever they stand."""
    data = padded(_LOWER[data] if lower else data)
    lanes, size = _lanes(data), ends - starts
    with np.errstate(over="ignore"):
        h = mix(size.astype(U64) * _LANE + U64(seed))
    h = mix(h ^ (lanes[starts] & _MASK[np.minimum(size, 8)]))
    active, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(active):
        rest = size[active] - at
        h[active] = mix(h[active] ^ (lanes[starts[active] + at] & _MASK[np.minimum(rest, 8)]))
        active, at = active[rest > 8], at + 8
    if len(big := np.flatnonzero(size > LONG)):
        view = memoryview(data)
        h[big] = np.fromiter((xxh3_64_intdigest(view[a:b], seed) for a, b in zip(starts[big].tolist(), ends[big].tolist(), strict=True)), U64, len(big))
    return h


def spans_equal(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes agree byte by byte; both buffers are ``padded``."""
    x, y = _lanes(a), _lanes(b)
    same = (x[a_starts] ^ y[b_starts]) & _MASK[np.minimum(size, 8)] == 0
    active, at = np.flatnonzero(same & (size > 8) & (size <= LONG)), 8
    while len(active):
        rest = size[active] - at
        good = (x[a_starts[active] + at] ^ y[b_starts[active] + at]) & _MASK[np.minimum(rest, 8)] == 0
        same[active] = good
        active, at = active[good & (rest > 8)], at + 8
    for i in np.flatnonzero(same & (size > LONG)).tolist():
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i] + size[i]], b[b_starts[i] : b_starts[i] + size[i]])
    return same


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x * _JOIN + y)


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` consecutive word hashes (``len - width + 1`` of them)."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, U64)
    # runs of 1, 2, 4, ... words, put together where the width has that bit
    out, done, power, size = None, 0, words, 1
    while True:
        if width & size:
            part = power[done : done + n]
            out = part if out is None else _joined(out, part)
            done += size
        if done == width:
            with np.errstate(over="ignore"):
                return mix(out + U64(width))
        power, size = _joined(power[:-size], power[size:]), 2 * size


def sequence_hash(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of the word hashes between consecutive ``bounds``."""
    view = memoryview(np.ascontiguousarray(words))
    at = bounds.tolist()
    return np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), U64, len(at) - 1)


class Texts:
    """A slice of a string column as bytes: ``data`` and the byte bounds of each document (null: empty)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the word bounds of each document."""
        d, off = self.data, self.offsets
        solid = ~((d == 32) | ((d >= 9) & (d <= 13)))
        first, last = solid.copy(), solid.copy()
        if len(d):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            edge = off[(off > 0) & (off < len(d))]
            first[edge] = solid[edge]
            last[edge - 1] = solid[edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, off)


class SpanIndex:
    """Numbers of distinct byte spans, kept from call to call: looked up by hash, confirmed byte by byte."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.empty(0, U64), np.empty(0, np.int64)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.text, self.used = np.zeros(1 << 16, np.uint8), 0
        #: Spans whose hash another span has.
        self.odd: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.begin)

    def _keep(self, spans: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, spans), np.int64, len(spans))
        total = int(size.sum())
        if self.used + total + 8 > len(self.text):
            self.text = np.concatenate([self.text[: self.used], np.zeros(max(len(self.text), total) + 8, np.uint8)])
        self.text[self.used : self.used + total] = np.frombuffer(b"".join(spans), np.uint8)
        numbers = len(self.begin) + np.arange(len(spans))
        self.begin, self.size = np.concatenate([self.begin, self.used + np.cumsum(size) - size]), np.concatenate([self.size, size])
        self.used += total
        return numbers

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The number of each span of ``data``, and the spans that are new, in the order of their numbers."""
        if not len(starts):
            return np.empty(0, np.int64), []
        unique, first, back = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != unique[inside]
        fresh = [data[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        if fresh:
            keys, at = np.concatenate([self.keys, unique[new]]), np.concatenate([self.at, self._keep(fresh)])
            order = np.argsort(keys)
            self.keys, self.at = keys[order], at[order]
        found = self.at[np.searchsorted(self.keys, unique)][back]
        size = ends - starts
        same = self.size[found] == size
        ok = np.flatnonzero(same)
        same[ok] = spans_equal(padded(data), starts[ok], self.text, self.begin[found[ok]], size[ok])
        for i in np.flatnonzero(~same).tolist():
            span = data[starts[i] : ends[i]].tobytes()
            if span not in self.odd:
                self.odd[span] = int(self._keep([span])[0])
                fresh.append(span)
            found[i] = self.odd[span]
        return found, fresh


def chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """``(first row, end row, Texts)`` over a string column, each of about ``limit`` bytes, covering every row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if column.null_count:  # a null may own bytes; it counts as empty
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.diff(offsets) * valid
        if (np.diff(offsets) != sizes).any():
            everything = np.concatenate([everything[a:b] for a, b, v in zip(offsets[:-1], offsets[1:], valid, strict=True) if v] or [np.empty(0, np.uint8)])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        a, b = offsets[i], offsets[j]
        yield i, j, Texts(everything[a:b], offsets[i : j + 1] - a)
        i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``[start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
