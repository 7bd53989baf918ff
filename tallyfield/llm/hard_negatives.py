"""Hard negatives by a multiway hyperplane tree.

Vectors are whole numbers and scores are inner products. One more coordinate, sqrt(top - |x|^2) with ``top`` the largest squared
norm, gives all rows the same norm, so with a zero there an anchor q has distance^2 = |q|^2 + top - 2 score to a row: a window of scores is
an annulus around the anchor. A node of the tree has ``WAYS`` split points; a row goes to the nearest one's subtree.
For every split point and sibling subtree the node stores the range of distances over all rows, and a sibling is eliminated
if for any split point that range does not meet the range that the anchor's annulus allows there. Leaves are compared exactly.

The split points come from a sample of at most ``SAMPLE`` rows (the smallest hashes of ids), so the tree has a bounded size and is
sent to all tasks; its ranges and leaves are of all rows. A leaf of many rows is dealt into cells of about ``CELL`` rows, and the
anchors that reach a leaf into blocks of about ``BLOCK``, so no group is larger, however many copies a vector has. Of equal vectors of one label only
those ids are kept that can be among the first (one more than positives, for the anchor itself); this loses no result.

A search has two steps: the anchor's own leaf first, then the leaves that the scores found there do not eliminate.

Rows with a null id, label or vector, a null or non-finite component, or a squared norm of 2^50 and more (scores must be
exact) take no part. Shorter vectors count as padded with zeros. A repeated row counts once; rows of one id with different vectors or labels are different rows,
but a row is no partner of an anchor with its own id. Ties go to the smaller id. Tables without anchors give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import stored

WAYS = 8
SAMPLE = 4096
LEAF = 1024
MAX_LEAVES = 1024
CELL = 4096
BLOCK = 2048
NO_SCORE = 1 << 62


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of whole numbers as doubles, padded with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, dtype=np.int64)
    values = np.asarray(flat.flatten(), dtype=np.float64)
    if len(flat) and (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(flat), dim))
    begins = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(flat)), lengths), np.arange(len(values)) - np.repeat(begins, lengths)] = values
    return out


@dataclass
class Tree:
    """Split points by node; a child is a node (0 and more) or a leaf (-1 - leaf). Ranges by (node, split point, child)."""

    dim: int
    top: float
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 1
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def _own(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", x, x), 0))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of rows to rows, all of one norm."""
        return np.sqrt(np.maximum(2 * (self.top - x @ y.T - self._own(x)[:, None] * self._own(y)[None, :]), 0))

    def from_anchors(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + self.top - 2 * scores, 0))

    def descend(self, x: np.ndarray, nearest: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(node, rows that reach it, child of each), from the root on."""
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            child = nearest(node, rows)
            yield node, rows, child
            for c, to in enumerate(self.children[node]):
                if to >= 0 and (child == c).any():
                    todo.append((to, rows[child == c]))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int32)
        for node, rows, child in self.descend(x, lambda node, rows: self.apart(x[rows], self.points[node]).argmin(axis=1)):
            to = np.array(self.children[node])[child]
            out[rows[to < 0]] = -1 - to[to < 0]
        return out

    def under(self) -> list[list[np.ndarray]]:
        """Leaves below each child of each node."""
        found: list[list[np.ndarray]] = [[] for _ in self.points]
        for node in range(len(self.points) - 1, -1, -1):  # children have larger numbers
            found[node] = [np.array([-1 - to]) if to < 0 else np.concatenate(found[to]) for to in self.children[node]]
        return found

    def reached(self, q: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """(anchor, leaf): may the leaf hold a row between the two radii around the anchor?"""
        out = np.zeros((len(q), self.leaves), dtype=bool)
        if not self.points:
            out[:] = True
            return out
        slack = 1e-6 + 1e-9 * (np.sqrt(self.top) + np.sqrt(np.einsum("ij,ij->i", q, q)))[:, None, None]
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            d = self.from_anchors(q[rows], q[rows] @ self.points[node].T)[:, :, None]
            r1, r2 = inner[rows, None, None], outer[rows, None, None]
            k = len(self.points[node])
            low, high = self.low[node, :k, :k][None], self.high[node, :k, :k][None]
            meets = (low <= d + r2 + slack[rows]) & (high >= np.maximum(d - r2, r1 - d) - slack[rows])
            alive = meets.all(axis=1)
            for c, to in enumerate(self.children[node]):
                if to < 0:
                    out[rows, -1 - to] = alive[:, c]
                elif alive[:, c].any():
                    todo.append((to, rows[alive[:, c]]))
        return out


def fit(sample: np.ndarray, top: float, leaves: int) -> Tree:
    """A tree of about ``leaves`` leaves: the node with the largest sample is split next, at points chosen farthest first."""
    tree = Tree(sample.shape[1], top)
    heap = [(-len(sample), 0, np.arange(len(sample)), None)]
    done, order = [], 1
    while heap:
        _, _, rows, parent = heapq.heappop(heap)
        chosen: list[int] = []
        if len(heap) + len(done) + 1 < leaves and len(rows) >= 2 * WAYS:
            near = np.full(len(rows), np.inf)
            while len(chosen) < WAYS and near.max() > 0:
                chosen.append(int(near.argmax()))
                near = np.minimum(near, tree.apart(sample[rows], sample[rows[chosen[-1:]]])[:, 0])
                near[chosen] = 0
        if len(chosen) < 2:
            done.append(parent)
            continue
        node = len(tree.points)
        tree.points.append(sample[rows[chosen]])
        tree.children.append([0] * len(chosen))
        if parent:
            tree.children[parent[0]][parent[1]] = node
        child = tree.apart(sample[rows], tree.points[node]).argmin(axis=1)
        for c in range(len(chosen)):
            part = rows[child == c]
            heapq.heappush(heap, (-len(part), order, part, (node, c)))
            order += 1
    for leaf, parent in enumerate(done):
        if parent:
            tree.children[parent[0]][parent[1]] = -1 - leaf
    tree.leaves = max(1, len(done))
    return tree


def _leaves(tree: Tree, place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the leaf of the vector in column ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(_matrix(batch.column(place), tree.dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    return run


def _with_ranges(tree: Tree, rows: DataFrame) -> Tree:
    """The tree with the ranges of distances over all rows, which come with their leaf."""
    under = tree.under()
    shape = (len(tree.points), WAYS, WAYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        child_of = [np.full(tree.leaves, -1) for _ in under]
        for node, parts in enumerate(under):
            for c, leaves in enumerate(parts):
                child_of[node][leaves] = c
        for batch in batches:
            x, leaf = _matrix(batch.column(0), tree.dim), batch.column(1).to_numpy()
            for node, at, child in tree.descend(x, lambda node, at: child_of[node][leaf[at]]):
                k = len(tree.points[node])
                d = tree.apart(x[at], tree.points[node])
                for c in np.unique(child):
                    low[node, :k, c] = np.minimum(low[node, :k, c], d[child == c].min(axis=0))
                    high[node, :k, c] = np.maximum(high[node, :k, c], d[child == c].max(axis=0))
        some = np.flatnonzero(np.isfinite(low.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(low.ravel()[some]), pa.array(high.ravel()[some])], ["place", "low", "high"])

    if tree.points:
        found = rows.select("v", "leaf").mapInArrow(run, "place long, low double, high double").groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        table = found.toPandas()  # at most MAX_LEAVES nodes
        tree.low, tree.high = np.full(shape, np.inf).ravel(), np.full(shape, -np.inf).ravel()
        tree.low[table.place], tree.high[table.place] = table.low, table.high
        tree.low, tree.high = tree.low.reshape(shape), tree.high.reshape(shape)
    return tree


def _routed(tree: Tree, home: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors (anchor_id, h, label, v, low, high, leaf) sent to their own leaf, or else to all others that their windows reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                if home:
                    yield some
                    continue
                q, own = _matrix(some.column(3), tree.dim), some.column(6).to_numpy()
                go = np.zeros((len(some), tree.leaves), dtype=bool)
                ends = some.column(4).value_lengths().to_numpy(zero_copy_only=False)
                low, high = (np.asarray(some.column(c).flatten(), dtype=np.float64) for c in (4, 5))
                begins = np.cumsum(ends) - ends
                for slot in range(int(ends.max(initial=0))):  # windows of one anchor are eliminated one by one
                    on = np.flatnonzero(ends > slot)
                    lo, hi = low[begins[on] + slot], high[begins[on] + slot]
                    outer, inner = tree.from_anchors(q[on], lo[:, None])[:, 0], tree.from_anchors(q[on], hi[:, None])[:, 0]
                    go[on] |= tree.reached(q[on], inner, outer) & (lo <= hi)[:, None]
                go[np.arange(len(some)), own] = False
                row, leaf = np.nonzero(go)
                for k in range(0, len(row), 4096):
                    cols = [some.column(c).take(pa.array(row[k : k + 4096])) for c in range(6)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(leaf[k : k + 4096].astype(np.int32))], some.schema.names)

    return run


def _compared(first: int, same: bool, dim: int):
    """The first rows of a cell for each window of the anchors of a block."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(anchors) and len(rows):
            rows = rows.take(np.argsort(rows["vec_id"].to_numpy(), kind="stable"))
            x, ids, label = _matrix(rows["v"], dim), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            for at in range(0, len(anchors), 256):
                some = anchors.slice(at, 256)
                own, own_label = some["anchor_id"].to_numpy(), some["label"].to_numpy()
                score = (_matrix(some["v"], dim) @ x.T).astype(np.int64)
                fits = ((label[None, :] == own_label[:, None]) == same) & (ids[None, :] != own[:, None])
                windows = [some[c].to_pylist() for c in ("low", "high")]
                for slot in range(max(map(len, windows[0]))):
                    low, high = (np.array([w[slot] if slot < len(w) else none for w in ws]) for ws, none in zip(windows, (1, 0)))
                    a, b = np.nonzero(fits & (score >= low[:, None]) & (score <= high[:, None]))
                    order = np.lexsort((b, -score[a, b], a))  # columns are in the order of ids
                    a, b = a[order], b[order]
                    begin = np.searchsorted(a, np.arange(len(some)))
                    best = np.arange(len(a)) - begin[a] < first
                    a, b = a[best], b[best]
                    out.append((own[a], some["h"].to_numpy()[a], np.full(len(a), slot), ids[b], score[a, b]))
        cols = [np.concatenate(c) if out else np.zeros(0, dtype=np.int64) for c in (zip(*out) if out else [[]] * 5)]
        return pa.table({"anchor_id": cols[0], "h": cols[1], "slot": pa.array(cols[2], pa.int32()), "id": cols[3], "score": cols[4]})

    return run


@dataclass
class Index:
    tree: Tree
    rows: DataFrame  # vec_id, label, v, leaf, cell
    cells: DataFrame  # leaf, cells: one row a leaf, at most MAX_LEAVES

    def _found(self, anchors: DataFrame, home: bool, first: int, same: bool) -> DataFrame:
        routed = stored(anchors.select("anchor_id", "h", "label", "v", "low", "high", "leaf").mapInArrow(_routed(self.tree, home), "anchor_id long, h long, label long, v array<int>, low array<long>, high array<long>, leaf int"), "anchors")
        blocks = routed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        plan = F.broadcast(self.cells.join(blocks, "leaf"))  # one row a leaf
        left = routed.join(plan, "leaf").withColumn("block", F.pmod(F.xxhash64("anchor_id", "h"), F.col("blocks")).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        right = self.rows.join(plan.drop("cells"), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key = ["leaf", "cell", "block"]
        groups = left.select(*key, "anchor_id", "h", "label", "v", "low", "high").groupBy(*key).cogroup(right.select(*key, "vec_id", "label", "v").groupBy(*key))
        return groups.applyInArrow(_compared(first, same, self.tree.dim), "anchor_id long, h long, slot int, id long, score long")

    def search(self, anchors: DataFrame, first: int, same: bool) -> DataFrame:
        """(anchor_id, h, slot, id, score, rank) of the first rows in each window of each anchor."""
        near = stored(_ranked(self._found(anchors, True, first, same), first), "near")
        bound = near.where(F.col("rank") == first).groupBy("anchor_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("bound"))
        tighter = F.transform("low", lambda x, i: F.coalesce(F.try_element_at("bound", i), x))  # ties at the bound may have smaller ids
        rest = anchors.join(bound, ["anchor_id", "h"], "left").withColumn("low", tighter)
        return _ranked(near.drop("rank").unionByName(self._found(rest, False, first, same)), first)


def _ranked(found: DataFrame, first: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "h", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)


def index(rows: DataFrame, ids_kept: int) -> Index:
    """The index of (vec_id, label, v) rows."""
    w = Window.partitionBy("label", "v").orderBy("vec_id")
    rows = rows.distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= ids_kept).drop("k")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = stored(rows, "vectors")
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(SAMPLE).select("v").toArrow()
    dim = max(int(dim or 0), 1)
    tree = fit(_matrix(sample["v"], dim), float(top or 0), min(MAX_LEAVES, -(-n // LEAF)))
    placed = stored(rows.select("vec_id", "label", "v").mapInArrow(_leaves(tree, 2), "vec_id long, label long, v array<int>, leaf int"), "placed")
    cells = placed.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("vec_id", "v"), F.col("cells")).cast("int").alias("cell")
    return Index(_with_ranges(tree, placed), placed.join(F.broadcast(cells), "leaf").select("vec_id", "label", "v", "leaf", cell), cells)


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v holds floor(scale * x), x as double."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("x")).where("vec_id is not null and label is not null and x is not null")
    good = rows.where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = good.withColumn("f", F.transform("x", lambda x: F.floor(F.when(F.abs(x) < 1e6, x).otherwise(1e6) * scale).cast("double")))
    return whole.where(F.aggregate("f", F.lit(0.0), lambda a, x: a + x * x) < float(1 << 50)).select("vec_id", "label", F.col("f").cast("array<int>").alias("v"))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the ``anchors`` among ``rows`` (vec_id, label, v).

    An anchor's positives are its first rows of the same label by score. Negatives are the first rows of other labels whose
    score is from ``low`` to ``high`` percent of the positive's.
    """
    found = index(rows, max(positives + 1, negatives))
    own = rows.where(anchors).distinct().select(F.col("vec_id").alias("anchor_id"), "label", "v", F.xxhash64("label", "v").alias("h"))
    asked = stored(own.mapInArrow(_leaves(found.tree, 2), "anchor_id long, label long, v array<int>, h long, leaf int"), "asked")
    anything = asked.withColumns({"low": F.array(F.lit(-NO_SCORE)), "high": F.array(F.lit(NO_SCORE))})
    best = stored(found.search(anything, positives, True).withColumn("slot", F.col("rank") - 1).drop("rank"), "positives")
    scores = best.groupBy("anchor_id", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "score"))), lambda x: x["score"]).alias("scores"))
    windows = asked.join(scores, ["anchor_id", "h"]).withColumns({
        "low": F.transform("scores", lambda p: F.expr("0L") - F.floor(p * -low / F.lit(100)).cast("long")),
        "high": F.transform("scores", lambda p: F.floor(p * high / F.lit(100)).cast("long")),
    })
    hard = found.search(windows, negatives, False)
    named = best.select("anchor_id", "h", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["anchor_id", "h", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id gets the next of ten labels, as noise."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
), n as (
  select p.anchor_id, positive_id, s.id as negative_id, positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id)::integer as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
