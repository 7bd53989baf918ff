"""Token ids as binary shards, one wavelet matrix file each, in ascending document order."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm import textarrays as ta
from tallyfield.llm.wavelet import WaveletMatrix, build
from tallyfield.session import scratch, stored

SHARD_IDS = 4_000_000
CHUNK_BYTES = 4 << 20
CACHE_BYTES = 160 << 20
READERS = 4096

# The normaliser and pre-tokenizer whose cuts are made here over bytes.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# The same pattern on lower-case ASCII and Latin-1 letters, and the words that it is used for.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
# Byte-level models write bytes that are no printable Latin-1 character as 256 and up, in order.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(_HIDDEN)}

_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x27] = _ODD  # words with an apostrophe are cut by the pattern
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SECOND = np.zeros(256, dtype=bool)  # second bytes of Latin-1 letters
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


def _grown(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """``x`` with room for ``more`` after ``used``; doubles, so that growing costs little on average."""
    if used + more <= len(x):
        return x
    out = np.zeros(max(2 * len(x), used + more), dtype=x.dtype)
    out[:used] = x[:used]
    return out


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the units of all texts as bytes, per text where its units begin).

    A word of ASCII and Latin-1 letters is lowered and cut into runs of letters, single digits and runs of other marks.
    Any other word, and one with an apostrophe or "<|", is one unit as it is.
    """
    starts, ends, _ = ta.words(data, offsets)
    kind = _KIND[data]
    second = np.zeros(len(data), dtype=bool)
    second[1:] = (data[:-1] == 0xC3) & _SECOND[data[1:]]
    kind[second] = _LETTER
    kind[np.flatnonzero(second) - 1] = _LETTER
    low = _LOWER[data]
    low[second & (data <= 0x9E)] += 0x20
    kind[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = _ODD
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(kind == _ODD, out=total[1:])
    odd = total[ends] > total[starts]
    if odd.any():
        step = np.zeros(len(data) + 1, dtype=np.int8)
        step[starts[odd]] += 1
        step[ends[odd]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        kind[inside] = _ODD
        low[inside] = data[inside]
    solid = kind != _BLANK
    new = solid.copy()
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edges = offsets[offsets < len(data)]
    new[edges] = solid[edges]
    at = np.flatnonzero(new)
    before = np.cumsum(solid, dtype=np.int64)
    begin = np.append(before[at] - 1, before[-1] if len(before) else 0).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(begin), pa.py_buffer(low[solid])])
    return found, np.searchsorted(at, offsets)


class WordEncoder:
    """Encodes whole texts through their distinct units.

    The expected tokenizer normalises, drops white space and cuts at it, so no token reaches over an ASCII blank: the ids of a
    text are those of its units one after another. Units are remembered, up to ``CACHE_BYTES`` of them. A file with
    another normaliser, pre-tokenizer or other added tokens encodes each text as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        cuts = steps[0].get("pattern") == {"Regex": _PATTERN} and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        bytewise = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        marks = all(x["content"].startswith("<|") and " " not in x["content"] for x in spec.get("added_tokens", []))
        self.by_unit = spec.get("normalizer") == _NORMALIZER and cuts and bytewise and marks
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.used, self.bytes = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _ids(self, part: str) -> list[int]:
        chars = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(chars)]

    def _learn(self, new: list[bytes]) -> None:
        ids: list[list[int] | None] = []
        for unit in new:
            text = unit.decode()
            if "'" not in text and "<|" not in text and _SIMPLE.fullmatch(text):
                ids.append(self._ids(text))
            elif "<|" not in text and _SIMPLE.fullmatch(text):
                ids.append([i for part in _PART.findall(text.lower()) for i in self._ids(part)])
            else:
                ids.append(None)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([new[i].decode() for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        total, at = int(sizes.sum()), len(self.place)
        self.flat = _grown(self.flat, self.used, total)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=total)
        self.starts, self.sizes = _grown(self.starts, at, len(new)), _grown(self.sizes, at, len(new))
        self.starts[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[at : at + len(new)] = sizes
        self.place.update(zip(new, range(at, at + len(new))))
        self.used += total
        self.bytes += sum(map(len, new)) + 4 * total + 160 * len(new)  # about what a unit's object and places take

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids in each); null texts are empty."""
        if not self.by_unit:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes
        found, bounds = units(*ta.flat(texts))
        coded = found.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.bytes > CACHE_BYTES:
            self._clear()
        self._learn([x for x in distinct if x not in self.place])
        slots = np.fromiter(map(self.place.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        which = coded.indices.to_numpy()
        sizes = self.sizes[slots][which]
        ends = np.cumsum(sizes)
        shift = self.starts[slots][which] - (ends - sizes)
        out = self.flat[np.repeat(shift, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.diff(np.concatenate([[0], ends])[bounds])


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _put(uri: str, data: bytes) -> None:
    """Writes a whole file or nothing, so that a repeated task leaves the same file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def _get(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def write_shards(docs: DataFrame, path: str, tokenizer: Callable[[], str], end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all documents below ``path`` and returns the manifest (part, seq, uri, n_docs, n_ids).

    Files follow each other in the order (part, seq), documents in ascending id; rows of one id in the order of their
    texts; null ids first. Null texts are empty. Each document ends with ``end_id``. ``tokenizer`` gives the vocabulary
    file's path on the executor. A shard is closed by the slice of about ``CHUNK_BYTES`` of text with which it
    reaches ``SHARD_IDS`` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer())
        part = TaskContext.get().partitionId()
        seq, held, held_ids = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, held_ids
            ids, keys, sizes = (np.concatenate([x[i] for x in held]) for i in range(3))
            uri = f"{path}/part-{part:06d}-{seq:05d}.wm"
            _put(uri, build(ids, keys, sizes))
            row = [[part], [seq], [uri], [len(keys)], [len(ids)]]
            seq, held, held_ids = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2]), pa.array(row[3], pa.int64()), pa.array(row[4], pa.int64())], ["part", "seq", "uri", "n_docs", "n_ids"])

        for batch in batches:
            _, offsets = ta.flat(batch.column(1))
            for a, b in ta.chunks(offsets, CHUNK_BYTES):
                some = batch.slice(a, b - a)
                ids, sizes = encoder.encode(some.column(1))
                whole = np.insert(ids, np.cumsum(sizes), end_id)
                held.append((whole, some.column(0).fill_null(-(1 << 63)).to_numpy(), sizes + 1))
                held_ids += len(whole)
                if held_ids >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "part int, seq int, uri string, n_docs long, n_ids long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; start counts the ids of all before."""
    # the running total over parts, of which there is one a writing task, then inside each part
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("own"))
    begins = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    placed = manifest.join(begins, "part").select("uri", (F.col("base") + inside).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = WaveletMatrix(_get(uri))
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                sums = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, shard.lengths)]
                keys = pa.array(shard.doc_ids, mask=shard.doc_ids == -(1 << 63))
                yield pa.RecordBatch.from_arrays([keys, pa.array(begin + ends - shard.lengths), pa.array(shard.lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # dealt in turn, as Spark would put these few rows into one task; a task holds one file at a time
    return placed.repartition(max(1, min(manifest.count(), READERS))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_and_read_back(docs: DataFrame, tokenizer: Callable[[], str] = word_bpe) -> DataFrame:
    """Writes ``docs`` as shards in the shared folder and reads them back; an empty table writes nothing."""
    return read_shards(write_shards(docs, scratch(docs.sparkSession, "tokens"), tokenizer))
