"""Elias-Fano sequences and a two-level trie over them, stored as one flat file that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_U8 = np.uint64(8)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The values' low ``bits`` bits, one after another, and 8 bytes of padding."""
    if not bits or not len(values):
        return np.zeros(8, dtype=np.uint8)
    out = []
    for a in range(0, len(values), 1 << 16):  # a multiple of 8 values ends at a byte
        v = values[a : a + (1 << 16)]
        flags = (v[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        out.append(np.packbits(flags.reshape(-1), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


class EliasFano:
    """A monotone sequence: low bits packed, high parts in unary. ``parts`` are the arrays that make it up."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._zeros: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        up = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros((int(up[-1]) if n else 0) + n + 1, dtype=bool)
        unary[up + np.arange(n)] = True
        return cls(n, bits, _pack(values, bits), np.packbits(unary, bitorder="little"))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), dtype=np.uint64)
        place = at * self.bits
        byte, shift = place >> 3, (place & 7).astype(np.uint64)
        word = np.zeros(len(at), dtype=np.uint64)
        for k in range((self.bits + 14) // 8):
            word |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return word >> shift & np.uint64((1 << self.bits) - 1)

    def _starts(self) -> np.ndarray:
        """Select directory: how many values have a high part below h, for every h."""
        if self._zeros is None:
            flags = np.unpackbits(np.asarray(self.high), bitorder="little").astype(bool)
            zeros = np.flatnonzero(~flags)
            self._zeros = np.concatenate([[0], np.minimum(zeros - np.arange(len(zeros)), self.n)])
        return self._zeros

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, -1 where it is not in the sequence: successor search inside the value's high bucket."""
        values = values.astype(np.uint64)
        out = np.full(len(values), -1, dtype=np.int64)
        starts = self._starts()
        up = (values >> np.uint64(self.bits)).astype(np.int64)
        inside = np.flatnonzero(up < len(starts) - 1)
        at, end = starts[up[inside]], starts[up[inside] + 1].copy()
        want = values[inside] & np.uint64((1 << self.bits) - 1)
        limit = end.copy()
        while True:  # binary search: a dense context can fill one bucket with very many values
            live = np.flatnonzero(at < end)
            if not len(live):
                break
            middle = (at[live] + end[live]) >> 1
            below = self._lows(middle) < want[live]
            at[live] = np.where(below, middle + 1, at[live])
            end[live] = np.where(below, end[live], middle)
        there = np.flatnonzero(at < limit)
        hit = self._lows(at[there]) == want[there]
        out[inside[there[hit]]] = at[there[hit]]
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        starts = self._starts()
        return (np.searchsorted(starts, at, "right") - 1).astype(np.uint64) << np.uint64(self.bits) | self._lows(at)


class BigramTrie:
    """Contexts -> successors with one code each.

    Level 1 holds the sorted contexts and the monotone pointers to where their successors begin. Level 2 holds all
    successors in one monotone sequence: those of a context are written relative to a base that is the sum of the ranges
    before it, so a successor is found by one search for base + word.
    """

    NAMES = ("contexts", "pointers", "bases", "successors")

    def __init__(self, data: np.ndarray) -> None:
        head = data[: 8 * (4 * len(self.NAMES) + 2)].view(np.uint64)
        at = len(head) * 8
        for i, name in enumerate(self.NAMES):
            n, bits, low, high = map(int, head[4 * i : 4 * i + 4])
            setattr(self, name, EliasFano(n, bits, data[at : at + low], data[at + low : at + low + high]))
            at += low + high
        backoffs, codes = map(int, head[-2:])
        self.backoff, self.code = data[at : at + backoffs], data[at + backoffs : at + backoffs + codes]

    @classmethod
    def pack(cls, contexts: np.ndarray, counts: np.ndarray, words: np.ndarray, backoff: np.ndarray, code: np.ndarray) -> np.ndarray:
        """File bytes. contexts: sorted distinct; counts: successors of each; words: sorted inside their context."""
        ends = np.cumsum(counts)
        spread = words[ends - 1].astype(np.uint64) + np.uint64(1) if len(ends) else np.zeros(0, np.uint64)
        bases = np.cumsum(spread) - spread
        parts = [EliasFano.build(x) for x in (contexts, ends, bases, words.astype(np.uint64) + np.repeat(bases, counts))]
        head = [x for p in parts for x in (p.n, p.bits, len(p.low), len(p.high))] + [len(backoff), len(code)]
        return np.concatenate([np.array(head, dtype=np.uint64).view(np.uint8), *[x for p in parts for x in (p.low, p.high)], backoff, code])

    def query(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, backoff code) of each pair; 0 where the pair or the context is not in the trie."""
        place = self.contexts.find(contexts)
        code, backoff = np.zeros(len(contexts), dtype=np.uint8), np.zeros(len(contexts), dtype=np.uint8)
        known = np.flatnonzero(place >= 0)
        if len(known):
            at = place[known]
            backoff[known] = self.backoff[at]
            base = self.bases.get(at)
            end = self.pointers.get(at).astype(np.int64)
            begin = np.where(at > 0, self.pointers.get(np.maximum(at - 1, 0)).astype(np.int64), 0)
            found = self.successors.find(base + words[known].astype(np.uint64))
            own = (found >= begin) & (found < end)  # base + word may lie in the next context's range
            code[known[own]] = self.code[found[own]]
        return code, backoff
