"""Array kernels on the bytes of Arrow string columns: whole batches at a time, no Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one kernel call works on (a longer document goes alone); bounds the temporaries.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), element by element."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = splitmix(_LOWER + 1000)
_BYTE[SPACE] = 0
_PLACE = splitmix(np.arange(4096) + 77) | np.uint64(1)
_TURN = splitmix(np.arange(8) + 4242) | np.uint64(1)


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts (one more entry than rows). Null is empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+, and the number of words before each row (rows + 1 entries)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.empty(len(buf), bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased: the sum over its bytes of byte value times place value."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = np.arange(start[0], len(buf)) - np.repeat(start, np.diff(start, append=len(buf)))
    table = _PLACE if place.max() < len(_PLACE) else splitmix(np.arange(int(place.max()) + 1) + 77) | np.uint64(1)
    return splitmix(np.add.reduceat(_BYTE[buf[start[0] :]] * table[place], start - start[0]))


def shingles(buf: np.ndarray, off: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles.

    A row with fewer words than `size` has its whole word sequence as one shingle; one without words has none.
    """
    start, _, before = word_spans(buf, off)
    words = word_hashes(buf, start)
    many = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        many += words[k : k + len(many)] * _TURN[k]
    many = splitmix(many)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(many[a : b - size + 1]))
        elif b > a:
            out.append(splitmix(np.array([(words[a:b] * _TURN[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
