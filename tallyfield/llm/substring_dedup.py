"""Substring deduplication with sliding sentence spans.

Every run of ``span`` consecutive sentences of a document is hashed. A run that occurs elsewhere before - in a document
with a smaller id, or earlier in its own - is a repeat, and every sentence that a repeat covers is removed. A sentence
ends after ``.``, ``!`` or ``?`` before white space, and at a line end; its words count, not its spacing or A-Z case.

Two further kinds of run catch passages of at least ``PASSAGE`` words with fewer whole sentences. Runs of one sentence or
more, up to ``span`` - 1, count from ``LONG`` words on. And anchors, runs of ``ANCHOR`` words wherever they begin, are chosen
by winnowing: of the anchors that begin in a window of PASSAGE words, the one with the smallest hash. Equal passages choose
equal anchors, so a repeated passage of PASSAGE words holds one at least, whatever its sentences. An anchor of an earlier
document that touches no removed sentence is cut word by word, with what adjoins it in the sentence kept.

Each document sends one row per run. Owners are found by an aggregate that combines before the shuffle; only runs that
repeat are joined back, and a run with a large part of all rows is dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm import textarrays as ta
from tallyfield.llm.skew import join_counted
from tallyfield.session import stored

SPAN = 3
MIN_WORDS = 10
LONG = 41
PASSAGE = 51
ANCHOR = 32

_STOP = np.zeros(256, dtype=bool)
_STOP[[0x21, 0x2E, 0x3F]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, hash, words, per document where its sentences begin); a sentence reaches to the next one's first byte."""
    starts, ends, bounds = ta.words(data, offsets)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts, bounds
    h = ta.word_hashes(data, starts, ends)
    breaks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(data == 0x0A, out=breaks[1:])
    new = np.zeros(len(starts), dtype=bool)
    new[1:] = _STOP[data[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1]])
    new[bounds[:-1][bounds[:-1] < len(starts)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))
    power, inverse = ta._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[:-1], out=total[1:], dtype=np.uint64)
    return starts[first], ta.mixed((total[last] - total[first]) * inverse[first]), last - first, np.searchsorted(first, bounds)


def spans(h: np.ndarray, words: np.ndarray, bounds: np.ndarray, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first sentence counted in it, hash) of every run of ``span`` sentences with at least ``min_words`` words."""
    n = np.diff(bounds)
    count = np.maximum(n - span + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = bounds[doc] + place
    out, size = np.full(len(at), 0x51ED270B, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    for j in range(span):
        out = ta.mixed(out * np.uint64(0x9FB21C651E98DF25) + h[at + j])
        size += words[at + j]
    big = size >= min_words
    return doc[big], place[big], out[big]


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width], for each i where that is whole."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word counted in it, hash) of every chosen anchor."""
    starts, ends, bounds = ta.words(data, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < PASSAGE:
        return none, none, np.zeros(0, np.uint64)
    h = ta.word_hashes(data, starts, ends)
    power, inverse = ta._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[:-1], out=total[1:], dtype=np.uint64)
    code = ta.mixed((total[ANCHOR:] - total[:-ANCHOR]) * inverse[: len(h) - ANCHOR + 1] + np.uint64(0x2545F491)) | np.uint64(1)
    width = PASSAGE - ANCHOR + 1
    least = _sliding(code, width, np.minimum)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    least[doc[: len(least)] != doc[PASSAGE - 1 :]] = 0
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == code)
    return doc[at], at - bounds[doc[at]], code[at]


def _emit(span: int, min_words: int, passages: bool):
    """Rows (doc_id, place, h, again); again: the document has the run before this place.

    place is 64 x first sentence + sentences, or -1 - first word for an anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.flat(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in ta.chunks(offsets):
                _, h, words, bounds = sentences(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for length in range(1 if passages else span, span + 1):
                    doc, place, code = spans(h, words, bounds, length, min_words if length == span else max(LONG, min_words))
                    order = np.lexsort((place, code, doc))
                    again = np.zeros(len(doc), dtype=bool)
                    again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (code[order[1:]] == code[order[:-1]])
                    yield rows(ids[a:b][doc], place * 64 + length, code, again)
                if passages:
                    doc, place, code = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    yield rows(ids[a:b][doc], -1 - place, code, np.zeros(len(doc), dtype=bool))

    def rows(ids: np.ndarray, mark: np.ndarray, code: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mark.astype(np.int64)), pa.array(code.view(np.int64)), pa.array(again)], ["doc_id", "place", "h", "again"])

    return run


def repeated_spans(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """(doc_id, place): every run that is not the first of its kind, placed as in ``_emit``. Null ids are left out."""
    if not 0 < span < 64:
        raise ValueError("span must be from 1 to 63")
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = base.mapInArrow(_emit(span, min_words, passages), "doc_id long, place long, h long, again boolean")
    owners = rows.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), F.max("again").alias("twice"), F.count("*").alias("n")).where("owner < other or twice")
    owners = stored(owners.select("h", "owner", "n"), "span-owners")
    return join_counted(rows, owners, ["h"], "doc_id").where("doc_id > owner or again").select("doc_id", "place")


def _cut(span: int, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.flat(batch.column(keep))
            marks = batch.column(keep + 1)
            had = batch.column(keep).is_valid().to_pylist()
            texts, totals, removed = [], [], []
            for a, b in ta.chunks(offsets):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                first, _, _, bounds = sentences(part, offs)
                for i in range(b - a):
                    n, marked = int(bounds[i + 1] - bounds[i]), marks[a + i].as_py()
                    whole = part[offs[i] : offs[i + 1]]
                    gone = np.zeros(n, dtype=bool)
                    if marked:
                        marked = np.array(marked)
                        runs = marked[marked >= 0]
                        for j in range(span):
                            gone[(runs // 64 + j)[runs % 64 > j]] = True
                        edges = np.append(first[bounds[i] : bounds[i + 1]] - offs[i], len(whole))
                        stays = np.ones(len(whole), dtype=bool)
                        stays[edges[0] :] = ~np.repeat(gone, np.diff(edges))
                        if (marked < 0).any():
                            starts, ends, _ = ta.words(whole, np.array([0, len(whole)]))
                            at = np.sort(-1 - marked[marked < 0])
                            low, high = (np.searchsorted(edges, starts[w], "right") - 1 for w in (at, at + ANCHOR - 1))
                            before = np.append(0, np.cumsum(gone))
                            free = before[high + 1] == before[low]
                            for w, x, y in zip(at[free], low[free], high[free]):
                                stays[starts[w] : starts[w + ANCHOR] if w + ANCHOR < len(starts) else ends[-1]] = False
                                gone[x : y + 1] = True
                        whole = whole[stays]
                    texts.append(whole.tobytes().decode("utf-8", "replace") if had[a + i] else None)
                    totals.append(n)
                    removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(texts, pa.string()), pa.array(totals, pa.int32()), pa.array(removed, pa.int32())], [*names])

    names: list[str] = []
    return run, names


def remove_repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, passages: bool = True) -> DataFrame:
    """The columns ``keep`` (default: the id) with text, n_sentences and n_removed, for every row.

    The first occurrence, in the smallest id and there at the smallest place, keeps its text. Null texts stay null, empty
    and blank texts and rows with a null id stay as they are. Rows of one id count as one document, so that equal rows of
    one id stay alike. n_removed counts the sentences that lost words, all of them or an anchor's.
    Without ``passages`` only runs of ``span`` sentences count. Other columns are not touched.
    """
    keep = [c for c in (keep or [id_col]) if c != text_col]
    marks = repeated_spans(docs, span, min_words, id_col, text_col, passages).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("place").alias("__marks"))
    run, names = _cut(span, len(keep))
    names += [*keep, text_col, "n_sentences", "n_removed"]
    base = docs.select(*keep, F.col(text_col).cast("string").alias("__text"), F.col(id_col).cast("long").alias("__key"))
    joined = base.join(marks.hint("merge"), F.col("__key") == F.col("__id"), "left").select(*keep, "__text", "__marks")
    schema = docs.select(*keep).schema.add(text_col, "string").add("n_sentences", "integer").add("n_removed", "integer")
    return joined.mapInArrow(run, schema)
