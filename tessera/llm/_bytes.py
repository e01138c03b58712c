"""Vectorised work on Arrow text columns: spans of bytes, their hashes, and tables of spans in numpy.

Texts are handled as UTF-8 bytes in blocks of about a megabyte; a longer row is a block of its own, and only
what is kept for each of its words or chunks follows its length. Spans are hashed eight bytes at a time by
multiplications and shifts. Hashes find candidates; ``SpanTable`` compares the bytes, so that what it finds
never rests on a hash alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
LONG = 2048  # spans of more bytes go through a library one by one
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_rng = np.random.default_rng(20240229)
GRAM = np.array([int(x) * 2 + 1 for x in _rng.integers(1 << 62, size=64)], dtype=np.uint64)
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * A
    h ^= h >> np.uint64(29)
    h = h * B
    return h ^ (h >> np.uint64(32))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def row_blocks(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian integers; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    return np.ndarray((len(buf) + 8,), "<u8", padded, 0, (1,))


def span_hashes(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of the bytes behind ``view``, eight bytes at a time."""
    h = mix(lengths.astype(np.uint64) * C + np.uint64(seed))
    h = _absorb(h, view[starts] & MASKS[np.minimum(lengths, 8)])
    rest, at = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 8
    while len(rest):
        left = lengths[rest] - at
        h[rest] = _absorb(h[rest], view[starts[rest] + at] & MASKS[np.minimum(left, 8)])
        at += 8
        rest = rest[left > 8]
    for i in np.flatnonzero(lengths > LONG).tolist():
        h[i] = _library(view, int(starts[i]), int(lengths[i]), seed)
    return h


def _absorb(h: np.ndarray, lane: np.ndarray) -> np.ndarray:
    h = (h ^ (lane * A)) * B
    h ^= h >> np.uint64(32)
    h *= C
    return h ^ (h >> np.uint64(29))


def _library(view: np.ndarray, start: int, length: int, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(span_bytes(view, start, length), seed)


def span_bytes(view: np.ndarray, start: int, length: int) -> bytes:
    return np.ndarray((length,), np.uint8, view.base, start).tobytes()


def same_spans(v: np.ndarray, a: np.ndarray, w: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of ``lengths`` bytes at ``a`` and ``b`` are equal."""
    same = (v[a] ^ w[b]) & MASKS[np.minimum(lengths, 8)] == 0
    rest, at = np.flatnonzero(same & (lengths > 8) & (lengths <= LONG)), 8
    while len(rest):
        left = lengths[rest] - at
        good = (v[a[rest] + at] ^ w[b[rest] + at]) & MASKS[np.minimum(left, 8)] == 0
        same[rest[~good]] = False
        rest, at = rest[good & (left > 8)], at + 8
    for i in np.flatnonzero(same & (lengths > LONG)).tolist():
        same[i] = span_bytes(v, int(a[i]), int(lengths[i])) == span_bytes(w, int(b[i]), int(lengths[i]))
    return same


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of spans, all of them together."""
    with np.errstate(over="ignore"):
        h = np.full(len(starts), np.uint64(seed) + P5)
    at, left = starts.copy(), lengths.copy()
    big = np.flatnonzero((lengths >= 32) & (lengths <= LONG))
    if len(big):
        big = big[np.argsort(-(lengths[big] // 32), kind="stable")]
        stripes, a = lengths[big] // 32, starts[big]
        s = np.uint64(seed)
        with np.errstate(over="ignore"):
            v = [np.full(len(big), x) for x in (s + P1 + P2, s + P2, s, s - P1)]
        live = len(big)
        for i in range(int(stripes[0])):
            live = int(np.searchsorted(-stripes[:live], -i, "left"))
            for k in range(4):
                v[k][:live] = _round(v[k][:live], view[a[:live] + (32 * i + 8 * k)])
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            acc = (acc ^ _round(np.zeros(len(x), np.uint64), x)) * P1 + P4
        h[big] = acc
        at[big] += stripes * 32
        left[big] -= stripes * 32
    h += lengths.astype(np.uint64)
    short = lengths <= LONG
    while len(live := np.flatnonzero(short & (left >= 8))):
        h[live] = _rotl(h[live] ^ _round(np.zeros(len(live), np.uint64), view[at[live]]), 27) * P1 + P4
        at[live] += 8
        left[live] -= 8
    if len(live := np.flatnonzero(short & (left >= 4))):
        h[live] = _rotl(h[live] ^ ((view[at[live]] & MASKS[4]) * P1), 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
    while len(live := np.flatnonzero(short & (left >= 1))):
        h[live] = _rotl(h[live] ^ ((view[at[live]] & MASKS[1]) * P5), 11) * P1
        at[live] += 1
        left[live] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        h[i] = _library(view, int(starts[i]), int(lengths[i]), seed)
    return h


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of class ``inside``: starts, ends and counts by row."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    mask = inside[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | first[1:-1]
    end[:-1] &= ~mask[1:] | first[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.diff(np.searchsorted(s, offsets))


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD, fold: bool = True, prefixes: tuple[int, ...] = (), seed: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of bytes of class ``inside``: starts, ends, counts by row, hashes (then hashes of prefixes); A-Z may be folded."""
    s, e, counts = spans(buf, offsets, inside)
    view = lanes(LOWER[buf] if fold else buf)
    return (s, e, counts, span_hashes(view, s, e - s, seed), *(span_hashes(view, s, np.minimum(e - s, size), k) for k, size in enumerate(prefixes, 1)))


def chunks(buf: np.ndarray, offsets: np.ndarray, safe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of every row before bytes whose pair with the byte before is ``safe``: starts and counts by row.

    ``safe`` is a flat table of 65,536 booleans by (byte before) * 256 + byte. A chunk ends where the next starts.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    cut = np.empty(len(buf), bool)
    cut[0] = True
    for a in range(1, len(buf), PIECE):
        b = min(len(buf), a + PIECE)
        cut[a:b] = safe[buf[a - 1 : b - 1].astype(np.uint16) * np.uint16(256) + buf[a:b]]
    cut[offsets[:-1][offsets[:-1] < len(buf)]] = True
    s = np.flatnonzero(cut)
    return s, np.diff(np.searchsorted(s, offsets))


class HashTable:
    """Open addressing from 64-bit hashes to integers, all lookups at once; 0 is kept as 1."""

    def __init__(self, bits: int = 22) -> None:
        self.mask, self.used = np.uint64((1 << bits) - 1), 0
        self.limit = (1 << bits) // 2
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        h = np.maximum(h, np.uint64(1))
        slot = (h & self.mask).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            key = self.keys[slot[open_]]
            found = key == h[open_]
            out[open_[found]] = self.values[slot[open_[found]]]
            open_ = open_[~found & (key != 0)]
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Add distinct hashes that aren't held yet."""
        h, values = np.maximum(h, np.uint64(1)), np.asarray(values, np.int32)
        slot = (h & self.mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = h[free]  # of several for one slot the last stays
            won = self.keys[slot[free]] == h[free]
            self.values[slot[free[won]]] = values[free[won]]
            left = np.setdiff1d(left, free[won], assume_unique=True)
            slot[left] = (slot[left] + 1) & int(self.mask)
        self.used += len(h)


class SpanTable:
    """Numbered spans, found by hash and then compared byte for byte."""

    def __init__(self, bits: int = 21) -> None:
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.table = HashTable(self.bits)
        self.n, self.n_bytes = 0, 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        raw = np.zeros(size + 16, np.uint8)
        if self.n_bytes:
            raw[: self.n_bytes] = self.raw[: self.n_bytes]
        self.raw = raw
        self.view = np.ndarray((size + 8,), "<u8", raw, 0, (1,))

    def add(self, h: np.ndarray | None, parts: list[bytes]) -> np.ndarray:
        """Numbers of new spans; without hashes they can't be found again."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        total = int(lengths.sum())
        while self.n + len(parts) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        if self.n_bytes + total + 16 > len(self.raw):
            self._grow(max(2 * len(self.raw), self.n_bytes + total))
        out = np.arange(self.n, self.n + len(parts))
        self.size[out] = lengths
        self.start[out] = self.n_bytes + np.cumsum(lengths) - lengths
        self.raw[self.n_bytes : self.n_bytes + total] = np.frombuffer(b"".join(parts), np.uint8)
        if h is not None:
            self.table.put(h, out)
        self.n, self.n_bytes = self.n + len(parts), self.n_bytes + total
        return out

    def equal(self, entry: np.ndarray, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the entries (0 or more) are the spans."""
        good = self.size[entry] == lengths
        at = np.flatnonzero(good)
        good[at] = same_spans(view, starts[at], self.view, self.start[entry[at]], lengths[at])
        return good

    def find(self, view: np.ndarray, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of spans, or -1."""
        entry = self.table.get(h)
        hit = np.flatnonzero(entry >= 0)
        entry[hit[~self.equal(entry[hit], view, starts[hit], lengths[hit])]] = -1
        return entry


def vocabulary(words_: list[bytes]) -> tuple[SpanTable, int]:
    """A table that finds each of these different words, and the seed of its hashes."""
    seed = 0
    while True:
        buf = np.frombuffer(b"".join(words_), np.uint8)
        lengths = np.fromiter(map(len, words_), np.int64, len(words_))
        h = np.maximum(span_hashes(lanes(buf), np.cumsum(lengths) - lengths, lengths, seed), np.uint64(1))
        if len(np.unique(h)) == len(h):
            table = SpanTable(max(8, (2 * len(h)).bit_length()))
            table.add(h, words_)
            return table, seed
        seed += 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def trimmed(scan: Callable) -> Callable:
    """``scan`` over Arrow batches, giving freed memory back to the system after each task.

    Workers are reused and stay; without this, each keeps what its largest task needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return run
