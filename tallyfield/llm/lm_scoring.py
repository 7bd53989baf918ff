"""Language-model scoring with a sharded Elias-Fano bigram trie.

Model: P(w | v) = a(v, w) + b(v) * P1(w), absolute discounting. a = (c(v, w) - D) / c(v) is kept as an 8-bit code on a log
scale, rounded down; b(v) is what the coded a leave of 1, coded alike; so no context's probabilities sum to more than 1.
P1(w) = (c(w) + 1) / (N + V + 1) is exact. A document's first
context and last token are the end mark. Nothing is pruned or capped, so vocabulary and trie grow with the corpus.

Neither vocabulary nor trie is ever whole in one place. Documents are packed once into chunks (local word numbers and the
chunk's distinct words). A chunk sends each shard one block with the distinct words, then the distinct pairs, that the
shard owns, with their training counts; the shard sums them over all chunks, builds its part and answers every block in
its own order, one small code per entry. The words' shard also numbers them by frequency, so pairs pack well. What is
shuffled is the distinct words and pairs of chunks, never single tokens, and a word in every document is one entry a chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm import textarrays as ta
from tallyfield.llm.eliasfano import BigramTrie
from tallyfield.session import scratch, stored

CHUNK_TEXT = 24 << 20
DISCOUNT = 0.75
END = np.uint64(1)
_NULL = -(1 << 63)
_FLOOR = -9.0  # log10 of the smallest coded value
_STEP = -_FLOOR / 254


def coded(x: np.ndarray) -> np.ndarray:
    """Codes 1..255 of values in (0, 1], rounded down; 0 is kept for what is not there."""
    return (255 - np.clip(np.ceil(np.log10(x) / -_STEP - 1e-9), 0, 254)).astype(np.uint8)


CODES = np.concatenate([[0.0], 10.0 ** (-_STEP * (255 - np.arange(1, 256)))])


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).reshape(-1)


def _put(uri: str, data: bytes | memoryview) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def _get(uri: str) -> np.ndarray:
    """A file's bytes: mapped where the store is a file system, else read."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=np.uint8, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def _put_arrays(uri: str, *arrays: np.ndarray) -> None:
    blobs = [_squeeze(x) for x in arrays]
    _put(uri, b"".join([np.array([len(b) for b in blobs], dtype="<u8").tobytes(), *blobs]))


def _get_arrays(uri: str, n: int) -> list[np.ndarray]:
    data = _get(uri)
    ends = np.cumsum(data[: 8 * n].view(np.uint64)).astype(np.int64) + 8 * n
    return [_unsqueeze(data[e - s : e].tobytes()) for e, s in zip(ends, data[: 8 * n].view(np.uint64).astype(np.int64))]


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that groups the entries by shard and keeps their order, where each shard begins)."""
    shard = (ta.mixed(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _chunks(path: str, shards: int):
    """Documents -> chunk files, and a block of distinct words for each shard."""

    def pack(held: list, seq: int) -> Iterator[pa.RecordBatch]:
        ids, train, sizes, hashes = (np.concatenate([x[i] for x in held]) for i in range(4))
        words, local = np.unique(hashes, return_inverse=True)
        counts = np.bincount(local[np.repeat(train, sizes)], minlength=len(words))
        chunk = TaskContext.get().partitionId() << 20 | seq
        _put_arrays(f"{path}/chunk-{chunk}", ids.view(np.uint64), train, sizes, local)
        order, begin = _by_shard(words, shards)
        full = np.flatnonzero(np.diff(begin))
        parts = [order[begin[s] : begin[s + 1]] for s in full]
        cols = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk)), pa.array([words[p].tobytes() for p in parts]), pa.array([_squeeze(counts[p]) for p in parts])]
        yield pa.RecordBatch.from_arrays(cols, ["shard", "chunk", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq = [], 0, 0
        for batch in batches:
            data, offsets = ta.flat(batch.column(2))
            ids = batch.column(0).fill_null(_NULL).to_numpy()
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in ta.chunks(offsets):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, bounds = ta.words(part, offs)
                hashes = np.insert(ta.word_hashes(part, starts, ends), bounds[1:], END)
                held.append((ids[a:b], train[a:b], np.diff(bounds) + 1, hashes))
                size += len(part) + b - a
                if size >= CHUNK_TEXT:
                    yield from pack(held, seq)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield from pack(held, seq)

    return run


def _count_words(shards: int):
    """All blocks of one shard: sums the training counts and answers each block with counts and global numbers."""

    def run(group: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(x, dtype=np.uint64) for x in group["words"].to_pylist()]
        words, place = np.unique(np.concatenate(blocks), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([_unsqueeze(x) for x in group["counts"].to_pylist()]), minlength=len(words)).astype(np.int64)
        number = np.empty(len(words), dtype=np.int64)
        number[np.lexsort((words, -total))] = np.arange(len(words))
        number = number * shards + group["shard"][0].as_py()
        ends = np.cumsum([len(b) for b in blocks])
        answers = [place[e - len(b) : e] for b, e in zip(blocks, ends)]
        n = len(blocks)
        first = np.arange(n) == 0
        return pa.table({"shard": group["shard"], "chunk": group["chunk"], "counts": [_squeeze(total[p]) for p in answers], "numbers": [_squeeze(number[p]) for p in answers], "n": np.where(first, total.sum(), 0), "v": np.where(first, np.count_nonzero(total), 0)})

    return run


def _pairs(path: str, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(context numbers, word numbers, the pair of each token, chunk arrays); pairs sorted by (context, word)."""
    ids, train, sizes, local = _get_arrays(f"{path}/chunk-{chunk}", 4)
    counts, numbers = _get_arrays(f"{path}/words-{chunk}", 2)
    sizes = sizes.astype(np.int64)
    local = local.astype(np.int64)
    before = np.empty_like(local)
    before[1:] = local[:-1]
    firsts = np.cumsum(sizes) - sizes
    before[firsts] = local[np.cumsum(sizes) - 1]  # the end mark
    rank = np.argsort(numbers, kind="stable")
    new = np.empty_like(rank)
    new[rank] = np.arange(len(rank))
    keys, pair = np.unique(new[before] * len(rank) + new[local], return_inverse=True)
    ordered = numbers[rank]
    return ordered[keys // len(rank)], ordered[keys % len(rank)], pair, [ids.view(np.int64), train.astype(bool), sizes, counts.astype(np.int64)[local]]


def _ask_pairs(path: str, shards: int):
    """The word answers of one chunk -> a block of distinct pairs for each shard."""

    def run(group: pa.Table) -> pa.Table:
        chunk = group["chunk"][0].as_py()
        parts = sorted(zip(group["shard"].to_pylist(), group["counts"].to_pylist(), group["numbers"].to_pylist()))
        counts, numbers = (np.concatenate([_unsqueeze(p[i]) for p in parts]) for i in (1, 2))
        words = np.concatenate([np.frombuffer(x, dtype=np.uint64) for _, x in sorted(zip(group["shard"].to_pylist(), group["words"].to_pylist()))])
        order = np.argsort(words)  # local numbers follow the hashes' order
        _put_arrays(f"{path}/words-{chunk}", counts[order], numbers[order])
        v, w, pair, (_, train, sizes, _) = _pairs(path, chunk)
        seen = np.bincount(pair[np.repeat(train, sizes)], minlength=len(v))
        by, begin = _by_shard(v, shards)
        rows = []
        for s in np.flatnonzero(np.diff(begin)):
            at = by[begin[s] : begin[s + 1]]
            rows.append((s, chunk, _squeeze(np.diff(v[at], prepend=np.uint64(0))), _squeeze(w[at]), _squeeze(seen[at])))
        cols = list(zip(*rows))
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int64()), "v": pa.array(cols[2], pa.binary()), "w": pa.array(cols[3], pa.binary()), "counts": pa.array(cols[4], pa.binary())})

    return run


def _trie_shard(path: str):
    """All pair blocks of one shard: builds and maps its trie, answers each block with codes."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        v = [np.cumsum(_unsqueeze(x), dtype=np.uint64) for x in group["v"].to_pylist()]
        w = [_unsqueeze(x) for x in group["w"].to_pylist()]
        counts = np.concatenate([_unsqueeze(x) for x in group["counts"].to_pylist()])
        taught = counts > 0
        all_v, all_w, all_c = np.concatenate(v)[taught], np.concatenate(w)[taught], counts[taught].astype(np.int64)
        order = np.lexsort((all_w, all_v))
        all_v, all_w, all_c = all_v[order], all_w[order], all_c[order]
        new = np.ones(len(all_v), dtype=bool)
        new[1:] = (all_v[1:] != all_v[:-1]) | (all_w[1:] != all_w[:-1])
        at = np.flatnonzero(new)
        c = np.add.reduceat(all_c, at) if len(at) else all_c
        contexts, begin, successors = np.unique(all_v[at], return_index=True, return_counts=True)
        total = np.add.reduceat(c, begin) if len(begin) else c
        a = coded((c - DISCOUNT) / np.repeat(total, successors))
        b = 1 - np.add.reduceat(CODES[a], begin) if len(begin) else np.zeros(0)
        uri = f"{path}/trie-{shard}"
        _put(uri, BigramTrie.pack(contexts, successors, all_w[at], coded(b), a).tobytes())
        trie = BigramTrie(_get(uri))
        codes, backoffs = [], []
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for x, y in zip(v, w):
            code, backoff = trie.query(x, y)
            codes.append(squeeze(code.tobytes()))
            backoffs.append(squeeze(backoff.tobytes()))
        return pa.table({"shard": group["shard"], "chunk": group["chunk"], "codes": pa.array(codes, pa.binary()), "backoffs": pa.array(backoffs, pa.binary())})

    return run


def _scores(path: str, shards: int, n: int, v: int):
    """The pair answers of one chunk -> a row for each of its documents."""

    def run(group: pa.Table) -> pa.Table:
        chunk = group["chunk"][0].as_py()
        context, _, pair, (ids, _, sizes, counts) = _pairs(path, chunk)
        parts = sorted(zip(group["shard"].to_pylist(), group["codes"].to_pylist(), group["backoffs"].to_pylist()))
        unpack = zstandard.ZstdDecompressor().decompress
        by, _ = _by_shard(context, shards)
        code, backoff = np.empty(len(by), np.uint8), np.empty(len(by), np.uint8)
        code[by] = np.frombuffer(b"".join(unpack(p[1]) for p in parts), np.uint8)
        backoff[by] = np.frombuffer(b"".join(unpack(p[2]) for p in parts), np.uint8)
        single = (counts + 1) / (n + v + 1)
        weight = np.where(backoff > 0, CODES[backoff], 1.0)
        begin = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, begin)
        score = total(np.log10(CODES[code][pair] + weight[pair] * single))
        return pa.table({"doc_id": pa.array(ids, mask=ids == _NULL), "n_tokens": sizes, "n_known": total((counts > 0).astype(np.int64)), "train_tokens": np.full(len(ids), n), "base_score": total(np.log10(single)), "score": score})

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from the rows where ``held_out`` is not true and scores all. Tokens are runs without ASCII white space, A-Z
    lowered, and one end mark a text; null and empty texts are their end mark alone. Repeated rows count and score each.
    base_score sums log10 of P1. An empty table gives an empty result; with nothing to learn from, N and V are 0.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "lm")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.col(text_col).cast("string").alias("text"))
    words = stored(base.mapInArrow(_chunks(path, shards), "shard int, chunk long, words binary, counts binary"), "lm-words")
    answers = stored(words.groupBy("shard").applyInArrow(_count_words(shards), "shard int, chunk long, counts binary, numbers binary, n long, v long"), "lm-counts")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    told = answers.drop("n", "v").join(words.select("shard", "chunk", "words"), ["shard", "chunk"])
    asked = told.groupBy("chunk").applyInArrow(_ask_pairs(path, shards), "shard int, chunk long, v binary, w binary, counts binary")
    pairs = stored(asked.groupBy("shard").applyInArrow(_trie_shard(path), "shard int, chunk long, codes binary, backoffs binary"), "lm-codes")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return pairs.groupBy("chunk").applyInArrow(_scores(path, shards, n, v), schema)
