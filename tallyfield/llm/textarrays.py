"""Vectorised text helpers that run inside Arrow tasks.

A batch of texts is handled as one flat UTF-8 byte array with document offsets, so tokenising and hashing are
array operations and no Python object is made per word. All separators are ASCII, so working on bytes is exact.
Every function works on whole texts; ``chunks`` only bounds how many bytes are worked on at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty. offsets has one entry more than the array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first : int(offsets[-1]) if len(offsets) else 0], offsets - first


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; one document is never cut."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without the bytes 0x20 and 0x09-0x0D, and per document where its words begin."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1 : len(data)]
    end[:-1] &= ~solid[1:] | edge[1 : len(data)]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS[:] = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lowered: differences of one running sum, so the cost is per byte, not per word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power[:-1], out=total[1:], dtype=np.uint64)
    h = (total[ends] - total[starts]) * inverse[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside documents and where each document's begin; a shorter document that has
    words gives its whole sequence as one."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begins = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bounds[:-1] - begins[:-1], count) + np.arange(begins[-1])
    length = np.minimum(np.repeat(n, count), k)
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        on = length > j
        if on.all():
            out = mixed(out * np.uint64(_BASE) + h[first + j])
        else:
            out[on] = mixed(out[on] * np.uint64(_BASE) + h[first[on] + j])
    return out, begins


def sorted_sets(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values sorted and distinct."""
    values = values.copy()
    for a, b in zip(begins[:-1], begins[1:]):
        values[a:b].sort()
    if not len(values):
        return values, begins
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    inner = begins[(begins > 0) & (begins < len(values))]
    new[inner] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return values[new], total[begins]
