"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is bound from its letters' vectors, each permuted by its
place: ``roll(L[a], 2) * roll(L[b], 1) * L[c]``. A document is the bundle (sum) of its trigrams, a language the bundle of
its training documents, and a document gets the language with the largest cosine. Letters are lower-cased; everything
else is one edge symbol, and every letter is the middle of exactly one trigram.

Bundles are exact integer sums, so results do not depend on batches or partitions. A task sums its own documents per
language and only those sums are shuffled; the prototypes, at most ``MAX_LANGUAGES`` vectors, go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm import textarrays as ta

DIM = 1024
SEED = 7
MAX_LANGUAGES = 1000
SEGMENT = 1 << 19

_LETTERS: list[np.ndarray] = []
_VECTORS: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    """By code point: the lower-case letter, 0 for what is no letter."""
    if not _LETTERS:
        out = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(out)
    return _LETTERS[0]


def _vector(letter: int) -> np.ndarray:
    if letter not in _VECTORS:
        _VECTORS[letter] = (np.random.default_rng([SEED, letter]).integers(0, 2, DIM) * 2 - 1).astype(np.int8)
    return _VECTORS[letter]


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``SEGMENT`` that begin with a character."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield at, end
        at = end


def bundles(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the trigram vectors of each group of documents, trigrams in each).

    Memory is bounded whatever the texts: segments cut long documents, with a character of context on either side, and
    vectors are made for one block of trigram kinds at a time.
    """
    out, total = np.zeros((groups, DIM)), np.zeros(groups, dtype=np.int64)
    for a, b in _segments(data):
        low, high = max(a - 1, 0), b
        while low and data[low] & 0xC0 == 0x80:
            low -= 1
        high += high < len(data)
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high += 1
        part = data[low:high]
        chars = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        place = np.flatnonzero((part & 0xC0) != 0x80) + low
        doc = np.searchsorted(offsets, place, "right") - 1
        alphabet, ids = np.unique(np.append(_letters()[chars], 0), return_inverse=True)
        ids = ids[:-1].astype(np.int64)
        size = len(alphabet)
        same = doc[1:] == doc[:-1]
        before, after = np.zeros_like(ids), np.zeros_like(ids)
        before[1:], after[:-1] = ids[:-1] * same, ids[1:] * same
        at = np.flatnonzero((ids > 0) & (place >= a) & (place < b))
        if not len(at):
            continue
        code = (before[at] * size + ids[at]) * size + after[at]
        kinds, which = np.unique(code, return_inverse=True) if size**3 > 1 << 24 else _dense(code, size**3)
        own = group[doc[at]]
        total += np.bincount(own, minlength=groups)
        tables = [np.roll(np.stack([_vector(int(c)) for c in alphabet]), k, axis=1) for k in (2, 1, 0)]
        width = max(64, min(8192, (1 << 21) // groups))
        order = np.argsort(which, kind="stable") if len(kinds) > width else slice(None)
        own, which = own[order], which[order]
        edges = np.searchsorted(which, np.arange(0, len(kinds) + width, width)) if len(kinds) > width else [0, len(which)]
        for n, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
            k = kinds[n * width : (n + 1) * width]
            vectors = (tables[0][k // size**2] * tables[1][k // size % size] * tables[2][k % size]).astype(np.float32)
            counts = np.bincount(own[x:y] * len(k) + which[x:y] - n * width, minlength=groups * len(k)).reshape(groups, len(k))
            out += counts.astype(np.float32) @ vectors  # whole numbers below 2^24, so exact in any order
    return out, total


def _dense(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(size, dtype=bool)
    seen[code] = True
    rank = np.cumsum(seen) - 1
    return np.flatnonzero(seen), rank[code]


@dataclass(frozen=True)
class Profiles:
    """Prototype vectors by language, in the order of their names."""

    names: tuple[str, ...]
    vectors: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the non-null values of ``lang_col``; null texts and rows without a language teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = ta.flat(batch.column(0))
            langs = pa.array(batch.column(1)).dictionary_encode()
            names, group = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for a, b in ta.chunks(offsets):
                found, _ = bundles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], group[a:b], len(names))
                for name, bundle in zip(names, found):
                    sums[name] = sums.get(name, 0) + bundle
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64) for v in sums.values()])], ["lang", "bundle"])

    taught = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string").alias("lang")).where(f"lang is not null and {text_col} is not null")
    sums = taught.mapInArrow(run, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    rows = sums.limit(MAX_LANGUAGES * DIM + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIM:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted({r.lang for r in rows})
    vectors = np.zeros((len(names), DIM))
    place = {name: i for i, name in enumerate(names)}
    for r in rows:
        vectors[place[r.lang], r.place] = r.x
    return Profiles(tuple(names), vectors)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score, for every row.

    score is the cosine with the predicted language's prototype, cut at 0. A text that is null or has no letter gets
    ``und`` and 0, as does every text when there are no profiles. Ties go to the first name. Texts are taken whole.
    """
    names = np.array([*profiles.names, "und"], dtype=object)
    norms = np.linalg.norm(profiles.vectors, axis=1, keepdims=True)
    unit = (profiles.vectors / np.where(norms > 0, norms, 1)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.flat(batch.column(len(keep)))
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            for a, b in _slices(offsets) if len(names) > 1 else ():
                found, total = bundles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.arange(b - a), b - a)
                length = np.linalg.norm(found, axis=1)
                cosines = found @ unit / np.where(length > 0, length, 1)[:, None]
                top = cosines.argmax(axis=1)
                has = total > 0
                best[a:b] = np.where(has, top, len(names) - 1)
                score[a:b] = np.where(has, np.clip(cosines[np.arange(b - a), top], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(score)], [*out])

    out = [*keep, "lang_pred", "score"]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in ta.chunks(offsets):
        for c in range(a, b, 1024):
            yield c, min(b, c + 1024)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(-1))


def identify(docs: DataFrame, id_col: str = "doc_id", held_out: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the rows outside the held-out fold, predicts all."""
    profiles = train(docs.where(fold(id_col, held_out) != 0))
    out = predict(docs, profiles, [id_col])
    return out.select(id_col, (fold(id_col, held_out) == 0).alias("held_out"), "lang_pred", "score")
