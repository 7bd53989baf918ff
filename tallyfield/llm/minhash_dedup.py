"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

Every shingle draws a random permutation of the signature's places together with ascending values ``r + j``; a place keeps
its smallest value (Ertl 2017). Values of step ``j`` lie in ``[j, j + 1)``, so once all places of a document hold a value
below ``j + 1`` no later step can change it: most documents stop after one or two steps. The steps are run for all
shingles of a batch at once.

Documents with equal shingle sets are one class and enter as one row. A band is ``rows`` places; ``rows`` is the largest
number for which a pair at the threshold misses every band with probability at most ``MISS``. In each bucket all members
are first held against the bucket's smallest document; where a bucket then still holds several components, all its members
are compared in blocks of bounded size, with full sets. No bucket is capped and no pair list of a bucket is emitted: links
found inside a block leave as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm import textarrays as ta
from tallyfield.llm.skew import join_counted
from tallyfield.operators.components import connected_components
from tallyfield.session import cut, stored

PLACES = 64
MISS = 1e-5
BLOCK = 256


def banding(threshold: float, places: int = PLACES) -> tuple[int, int]:
    """(bands, rows in each)."""
    for rows in range(places, 0, -1):
        if (1 - threshold**rows) ** (places // rows) <= MISS:
            return places // rows, rows
    return places, 1


def superminhash(values: np.ndarray, begins: np.ndarray, places: int = PLACES) -> np.ndarray:
    """One row of ``places`` values per document; rows of empty documents stay infinite."""
    n = len(begins) - 1
    sig = np.full(n * places, np.inf)
    counts = np.diff(begins)
    doc = np.repeat(np.arange(n), counts)
    order: np.ndarray | None = None
    open_docs = counts > 0
    for j in range(places):
        if j:
            stay = open_docs[doc]
            if not stay.any():
                break
            if not stay.all():
                values, doc = values[stay], doc[stay]
                order = order[stay] if order is not None else None
        draw = ta.mixed(values + np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64)))
        r = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + ((ta.mixed(draw ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k
        else:
            if order is None:  # the first swap, now that few shingles are left
                order = np.tile(np.arange(places, dtype=np.uint8), (len(values), 1))
                first = ta.mixed(ta.mixed(values + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
                k0 = (first * np.uint64(places) >> np.uint64(32)).astype(np.int64)
                at = np.arange(len(values))
                order[at, k0] = 0
                order[:, 0] = k0
            at = np.arange(len(values))
            place = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(sig, doc * places + place, r + j)
        full = (sig.reshape(n, places) < j + 1).all(axis=1)
        open_docs &= ~full
    return sig.reshape(n, places)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = ta.words(data, offsets)
    return ta.sorted_sets(*ta.shingle_hashes(ta.word_hashes(data, starts, ends), bounds, k))


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:], dtype=np.uint64)
    return (total[begins[1:]] - total[begins[:-1]]).view(np.int64)


def _signatures(k: int, bands: int, rows: int):
    names = ["doc_id", "n_shingles", "d1", "d2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.flat(batch.column(1))
            for a, b in ta.chunks(offsets):
                values, begins = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                sig = superminhash(values, begins)[:, : bands * rows].copy().view(np.uint64).reshape(b - a, bands, rows)
                h = np.full((b - a, bands), 0x2545F4914F6CDD1D, dtype=np.uint64)
                for i in range(rows):
                    h = ta.mixed(h * np.uint64(0x9FB21C651E98DF25) + sig[:, :, i])
                lists = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * bands, h.reshape(-1).view(np.int64))
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(begins)), pa.array(_sums(ta.mixed(values ^ np.uint64(0xA24BAED4963EE407)), begins)), pa.array(_sums(ta.mixed(values ^ np.uint64(0x9FB21C651E98DF25)), begins)), lists]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _confirmed(k: int, percent: int):
    """Keeps the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for c in (2, 3):
                data, offsets = ta.flat(batch.column(c))
                sets = []
                for a, b in ta.chunks(offsets):
                    values, begins = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                    sets += [values[begins[i] : begins[i + 1]] for i in range(b - a)]
                both.append(sets)
            keep = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(*both)):
                if len(x) and len(y):
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _shared(x: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block of sets."""
    n = len(x)
    row = np.repeat(np.arange(n), [len(s) for s in x])
    _, col, times = np.unique(np.concatenate(x), return_inverse=True, return_counts=True)
    often = times[col] > 1
    row, col = row[often], np.unique(col[often], return_inverse=True)[1]
    out = np.zeros((n, n), dtype=np.int64)
    width = int(col.max()) + 1 if len(col) else 0
    by_col = np.argsort(col, kind="stable")
    row, col = row[by_col], col[by_col]
    for at in range(0, width, 8192):
        a, b = np.searchsorted(col, [at, at + 8192])
        m = np.zeros((n, min(8192, width - at)), dtype=np.float32)
        m[row[a:b], col[a:b] - at] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _block_links(k: int, percent: int):
    """A spanning forest over the components of one block of a bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if pdf["comp"].nunique() > 1:
            data, offsets = ta.flat(pa.array(pdf["text"], type=pa.large_string()))
            sets = []
            for a, b in ta.chunks(offsets):
                values, begins = _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                sets += [values[begins[i] : begins[i + 1]] for i in range(b - a)]
            size = np.array([len(s) for s in sets])
            common = _shared(sets)
            linked = np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1)
            comp, doc = pdf["comp"].to_numpy(), pdf["doc_id"].to_numpy()
            root = {c: c for c in comp}
            for i, j in zip(*np.nonzero(linked & (comp[:, None] != comp[None, :]))):
                a, b = root[comp[i]], root[comp[j]]
                if a != b:
                    found.append((doc[i], doc[j]))
                    root = {c: (a if r == b else r) for c, r in root.items()}
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a text's set holds its distinct runs of ``k``
    words, or its whole sequence if it has fewer. Two texts are linked if 100 * shared >= percent * union. component_id is
    the smallest id reachable over links, kept whether that is the own id. Null, empty and blank texts have the empty set,
    are linked with nothing and kept. Rows with a null id are returned with their size, a null component and kept true.
    A repeated id stands for one document with several texts: its rows share one component. An empty table gives an empty
    result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bands, rows = banding(percent / 100)
    schema = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
    sig = stored(base.mapInArrow(_signatures(k, bands, rows), schema), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    of_class = join_counted(full.select("doc_id", "n_shingles", "d1", "d2"), classes, ["n_shingles", "d1", "d2"], "doc_id").select("doc_id", "rep")
    reps = classes.drop("n").join(full.withColumnRenamed("doc_id", "rep"), ["n_shingles", "d1", "d2", "rep"]).select("rep", "n_shingles", F.posexplode("bands").alias("band", "h"))
    slots = reps.select("band", "h", "rep", "n_shingles")
    buckets = stored(slots.groupBy("band", "h").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "bucket-counts")
    members = stored(join_counted(slots, buckets, ["band", "h"], "rep").distinct(), "buckets")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    # merge hints: candidates grow with the input, so the plan is the shuffled one at every size
    texts = stored(base.join(wanted.hint("merge"), "doc_id", "left_semi"), "candidates")

    size = members.select(F.col("rep").alias("pivot"), F.col("n_shingles").alias("n_pivot")).distinct()
    pairs = members.where("rep > pivot").select("rep", "pivot", "n_shingles").distinct().join(size, "pivot")
    ratio = 100 * F.least("n_shingles", "n_pivot") >= percent * F.greatest("n_shingles", "n_pivot")
    texted = (
        pairs.where(ratio)
        .join(texts.select(F.col("doc_id").alias("rep"), F.col("text").alias("text_a")).hint("merge"), "rep")
        .join(texts.select(F.col("doc_id").alias("pivot"), F.col("text").alias("text_b")).hint("merge"), "pivot")
        .select(F.col("rep").alias("a"), F.col("pivot").alias("b"), "text_a", "text_b")
    )
    several = of_class.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    by_id = of_class.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stored(texted.mapInArrow(_confirmed(k, percent), "a long, b long").union(by_id), "links")
    comp = cut(connected_components(links, "a", "b"))

    labelled = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("band", "h", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = stored(labelled.groupBy("band", "h").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("m")).where("c1 < c2 and m > 2").select("band", "h", "m"), "mixed")
    unsettled = join_counted(labelled, mixed, ["band", "h"], "rep", "m").drop("m")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    blocks = unsettled.select("band", "h", "rep", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select("band", "h", "rep", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    more = (
        blocks.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
        .select("band", "h", "i", "j", F.col("rep").alias("doc_id"), "comp", "text")
        .groupBy("band", "h", "i", "j")
        .applyInPandas(_block_links(k, percent), "a long, b long")
    )
    if mixed.limit(1).count():
        all_links = links.union(stored(more, "more-links"))
        comp = cut(connected_components(all_links, "a", "b"))
    of_rep = of_class.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    whole = of_rep.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sig.select("doc_id", "n_shingles").join(whole, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
