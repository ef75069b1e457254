"""Numpy kernels over ragged byte strings: words, rolling word hashes, shingle sets.

All functions take the UTF-8 bytes of a batch of texts laid end to end with the
row offsets, so a batch costs a few vector passes and no per-word Python.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the working arrays of every kernel.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Words longer than this are finished one by one.
LOCKSTEP = 48


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges (i, j) of at most `most` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces of `data` laid end to end."""
    at = np.cumsum(lengths) - lengths
    return data[np.arange(int(lengths.sum())) + np.repeat(starts - at, lengths)]


def packed(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed string."""
    raw = b"".join(x for c in columns for x in (c.dtype.str.encode().ljust(8), len(c).to_bytes(8, "little"), np.ascontiguousarray(c).tobytes()))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(x: bytes) -> list[np.ndarray]:
    raw, at, out = pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 8].decode().strip()), int.from_bytes(raw[at + 8 : at + 16], "little")
        out.append(np.frombuffer(raw, kind, n, at + 16))
        at += 16 + n * kind.itemsize
    return out


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words between bytes of `space`, ASCII white space, and each row's first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends - starts + 1, np.searchsorted(starts, offsets)


def by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of segments from long to short, and how many are longer than k for k = 0 .. LOCKSTEP."""
    short = np.minimum(lengths, LOCKSTEP + 1).astype(np.uint8)
    order = np.argsort(np.uint8(255) - short, kind="stable")
    count = np.bincount(short, minlength=LOCKSTEP + 2)
    return order, len(lengths) - np.cumsum(count)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of every segment; a step handles the k-th byte of all segments that have one."""
    order, longer = by_length(lengths)
    at, h = starts[order], np.full(len(starts), M1, dtype=np.uint64)
    for k in range(LOCKSTEP):
        m = int(longer[k])
        if not m:
            break
        part = h[:m]
        part ^= data[at[:m] + k]
        part *= M2
        part ^= part >> np.uint64(29)
    for i in range(int(longer[LOCKSTEP])):
        j = order[i]
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[j] : starts[j] + lengths[j]].tobytes(), digest_size=8).digest(), "little")
    out = np.empty_like(h)
    out[order] = mix(h ^ lengths[order].astype(np.uint64))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Per row the sorted distinct hashes of its `width`-word shingles of lower-cased words.

    A row of fewer words has one shingle, all its words; a row without words none.
    """
    data = LOWER[data]
    starts, lengths, first = words(data, offsets)
    h = word_hashes(data, starts, lengths)
    n = len(h)
    m = max(0, n - width + 1)
    full = np.full(m, M1, dtype=np.uint64)
    for k in range(width):
        full = (full ^ h[k : m + k]) * M3
        full ^= full >> np.uint64(32)
    full = mix(full)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            x = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                x = mix((x ^ h[k]) * M3)
            yield x
        else:
            yield np.zeros(0, dtype=np.uint64)
