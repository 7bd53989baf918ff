"""A wavelet matrix in one compressed file: access, counting and occurrence lookup on token ids.

Layout: magic, lengths, a directory of compressed blocks, then the blocks. Plane 0 holds the highest bit of every id in
document order; each next plane holds the next bit after a stable partition by the planes before it, zeros first. A plane
is stored in blocks of ``BLOCK`` bits, each compressed alone, with the number of ones before it, so rank needs one block.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard

MAGIC = b"TFWMAT01"
BLOCK = 1 << 16
_HEAD = struct.Struct("<8sQQIQ")  # magic, ids, documents, planes, bytes of the document table


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of the ids of some documents, given one after another; ``lengths`` has the ids of each document."""
    pack = zstandard.ZstdCompressor(level=1)
    ids = ids.astype(np.uint32, copy=False)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if planes <= 16:
        ids = ids.astype(np.uint16)
    blocks: list[bytes] = []
    ones: list[np.ndarray] = []
    zeros = []
    for p in range(planes - 1, -1, -1):
        bits = np.packbits((ids >> p & 1).astype(bool), bitorder="little")
        raw = [bits[i : i + BLOCK // 8].tobytes() for i in range(0, len(bits), BLOCK // 8)]
        per = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8), dtype=np.uint64) if len(bits) else np.zeros(0, np.uint64)
        ones.append(np.concatenate([[0], np.cumsum(per)]).astype(np.uint64))
        blocks += [pack.compress(x) for x in raw]
        zeros.append(len(ids) - int(ones[-1][-1]))
        if p:  # Arrow filters by packed bits
            halves = [pa.array(ids).filter(pa.Array.from_buffers(pa.bool_(), len(ids), [None, pa.py_buffer(x)])) for x in (~bits, bits)]
            ids = np.concatenate([x.to_numpy() for x in halves])
    table = pack.compress(np.concatenate([doc_ids.astype("<i8"), lengths.astype("<i8")]).tobytes())
    ends = np.cumsum([len(x) for x in blocks], dtype=np.uint64) if blocks else np.zeros(0, np.uint64)
    head = _HEAD.pack(MAGIC, int(np.sum(lengths)), len(doc_ids), planes, len(table))
    return b"".join([head, np.array(zeros, dtype="<u8").tobytes(), ends.astype("<u8").tobytes(), *[x.astype("<u8").tobytes() for x in ones], table, *blocks])


class WaveletMatrix:
    """Reads a file made by ``build``; ``data`` may be bytes or a memory map. Blocks are unpacked when they are needed."""

    def __init__(self, data: bytes | memoryview) -> None:
        magic, self.n, docs, self.planes, table = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.data, at = memoryview(data), _HEAD.size
        self.per = -(-self.n // BLOCK)

        def numbers(count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype="<u8", count=count, offset=at)
            at += 8 * count
            return out

        self.zeros = numbers(self.planes)
        self.ends = np.concatenate([[0], numbers(self.planes * self.per)]).astype(np.int64)
        self.ones = numbers(self.planes * (self.per + 1)).reshape(self.planes, self.per + 1).astype(np.int64)
        self._unpack = zstandard.ZstdDecompressor()
        docs_table = np.frombuffer(self._unpack.decompress(self.data[at : at + table]), dtype="<i8")
        self.doc_ids, self.lengths = docs_table[:docs], docs_table[docs:]
        self.at = at + table
        self._last: tuple[int, np.ndarray] | None = None

    def _block(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.per + block
        if self._last is None or self._last[0] != k:
            raw = self._unpack.decompress(self.data[self.at + self.ends[k] : self.at + self.ends[k + 1]])
            bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")
            self._last = (k, bits[: self.n - block * BLOCK])
        return self._last[1]

    def _rank1(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK)
        return int(self.ones[plane, block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        before = self.ones[plane] if bit else np.minimum(np.arange(self.per + 1) * BLOCK, self.n) - self.ones[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.planes):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK])
            out = out << 1 | bit
            one = self._rank1(p, i)
            i = int(self.zeros[p]) + one if bit else i - one
        return out

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self._rank1(p, start), self._rank1(p, stop)
            if token >> (self.planes - 1 - p) & 1:
                start, stop = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``token`` in [start, stop)."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for p in range(self.planes - 1, -1, -1):
            bit = np.concatenate([self._block(p, b) for b in range(self.per)] or [np.zeros(0, np.uint8)]).astype(bool)
            back, zeros = np.empty_like(out), int(self.zeros[p])
            back[~bit], back[bit] = out[:zeros], out[zeros:]
            out = back | bit.astype(kind) << kind(self.planes - 1 - p)
        return out
