"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on many random directions. Two vectors of a label collide on a direction if both lie beyond a fixed
cut on the same side, and in the window that is centred on either's projection there. Vectors are sorted by projection
inside the tails, and pairs that collide there are candidates. Their collisions are counted over ``COUNTED`` further directions
with the same window, and a pair is linked if it passes the count and its cosine in double precision the threshold. Cosines in
single precision, less their error, come first and leave out what cannot be linked.

Calibration. On a random direction the projections of a pair are jointly normal with the pair's cosine as correlation,
whatever else the table holds: a vector near its label's mean is as likely beyond the cut as any other. The cut is a number and no
quantile of the data, so the chance that a pair at the threshold collides on a direction is known. The number of directions makes
the chance of fewer collisions than demanded at most ``MISS``, and the count demanded is the largest that such a
pair passes with probability 1 - ``MISS``. ``plan`` picks cut and directions by the number of vectors compared, so that what
vectors that point everywhere cost stays smallest.

Vectors are sent once: distinct ones are written in blocks to the shared folder, labels of more than a block in several. A task
reads one block, or two of a large label, and makes all its tails in memory, so neither tails nor pairs are sent or written, and what
is written grows as the rows do. A pair that meets in several tails is linked where it first has the collisions demanded, and a task
sends one row for each vector that it has linked: the sum of its links and the smallest vector joined.

Near copies. Vectors that lie within half the threshold's angle of one centre are linked with each other, whatever their
number: such a knot is found by signs that many share, and others are held against its centre. By the angles' triangle
inequality most are linked with all of the knot or none; the rest are compared with its vectors one by one.

Equal vectors of a label are one class: it enters once, and its size counts for the links of its partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallyfield.llm.skew import join_counted
from tallyfield.operators.components import connected_components
from tallyfield.session import cut, scratch, stored

BLOCK = 1 << 17  # vectors of 64 components that a block holds
MAX_DIRECTIONS = 4096
COUNTED = 64
WIDTH = 2.5
MISS = 1e-6
SLAB = 256  # directions whose tails are held at once
KNOT = 32  # near copies that are worth a centre
CENTRES = 256
SLACK = 1e-6  # of angles, beyond their rounding
# nanoseconds: a projection of a vector, a vector in a tail, a tail, a comparison
COSTS = 5, 200, 50_000, 2


def demanded(width: float = WIDTH, counted: int = COUNTED, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - miss."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for k in range(counted + 1):
        below += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        if below > miss:
            return k
    return counted


def meeting(cut: float, cosine: float, window: float) -> float:
    """Chance that a pair with this cosine lies beyond ``cut`` in one given tail, not farther apart than ``window``."""
    x = np.linspace(cut, cut + 10, 4001)
    spread = math.sqrt(2 * max(1e-12, 1 - cosine**2))
    normal = np.vectorize(math.erf)
    inside = normal((x + window - cosine * x) / spread) - normal((np.maximum(cut, x - window) - cosine * x) / spread)
    return float(np.trapezoid(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * inside / 2, x))


def needed(chance: float, order: int) -> int:
    """Directions with which a pair that collides on each with this chance has ``order`` collisions, but for ``MISS``."""

    def short(m: int) -> float:
        return sum(math.comb(m, k) * chance**k * (1 - chance) ** (m - k) for k in range(order))

    low, high = order - 1, order
    while short(high) > MISS:
        if high > 4 * MAX_DIRECTIONS:
            return high
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if short(middle) <= MISS else (middle, high)
    return high


@cache
def _options(threshold: float, window: float) -> tuple[tuple[int, float, int], ...]:
    """All (collisions, cut, directions) within ``MAX_DIRECTIONS``."""
    out = []
    for cut_at in np.arange(0, 4, 0.125):
        chance = 2 * meeting(float(cut_at), threshold, window)
        if chance > 0 and (m := needed(min(chance, 1 - 1e-9), 1)) <= MAX_DIRECTIONS:
            out.append((1, float(cut_at), m))
    return tuple(out)


def plan(n: int, threshold: float, window: float) -> tuple[int, float, int]:
    """(collisions of a candidate, cut, directions) with the least cost for ``n`` vectors that are compared."""

    def cost(option: tuple[int, float, int]) -> float:
        _, cut_at, m = option
        held = n * math.erfc(cut_at / math.sqrt(2)) / 2
        project, send, tail, compare = COSTS
        return m * (n * project + 2 * (held * send + tail + held * held / 2 * compare))

    return min(_options(threshold, window), key=cost)


@cache
def _directions(count: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, count))


def _units(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length, scaled to length 1."""
    v = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    # by the largest component first, so that squares neither overflow nor vanish
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Rows with an id, a label and a finite vector that is not zero: (vec_id, space, h, v). A space is a label's vectors of one length."""
    kind = vectors.select(vec_col).schema[0].dataType
    v = F.col(vec_col) if kind == ArrayType(FloatType(), kind.containsNull) else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).where("vec_id is not null and label is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(~bad).where(F.exists("v", lambda x: x != 0))
    return kept.select("vec_id", F.concat_ws(":", F.size("v"), "label").alias("space"), F.xxhash64("v").alias("h"), "v")


def _smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n is joined to by the pairs (a, b)."""
    to = np.arange(n)
    while True:
        least = np.minimum(to[a], to[b])
        new = to.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, to):
            return to
        to = new


class _Found:
    """Links of each of some vectors, whose sizes are given, and what they join."""

    def __init__(self, size: np.ndarray):
        self.size, self.links, self.to = size, np.zeros(len(size), np.int64), np.arange(len(size))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.links, a, self.size[b])
        np.add.at(self.links, b, self.size[a])
        self.join(a, b)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, np.broadcast_to(b, a.shape)))
        self.held += len(a)
        if self.held > 1 << 20:
            self.joined()

    def joined(self) -> np.ndarray:
        a, b = (np.concatenate([*x]) for x in zip(*self.edges, (np.arange(len(self.to)), self.to)))
        self.to, self.edges, self.held = _smallest(a, b, len(self.to)), [], 0
        return self.to


def _knots(u: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centre, members) of groups in which every two are linked; no vector is in two."""
    if len(u) < KNOT:
        return []
    bucket = np.packbits(u @ _directions(16, u.shape[1], 7) >= 0, axis=1).view(np.uint16).ravel()
    filled = np.bincount(bucket, minlength=1 << 16)
    most = np.argsort(-filled, kind="stable")[:CENTRES]
    most = most[filled[most] >= max(KNOT // 4, 8 * len(u) >> 16)]
    order = np.argsort(bucket, kind="stable")  # of 16 bits, so by digits
    ends = np.cumsum(filled)
    centres = np.array([u[order[ends[k] - filled[k] : ends[k]]].sum(axis=0) for k in most]).reshape(-1, u.shape[1])
    centres = centres[np.abs(centres).max(axis=1, initial=0) > SLACK]
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    least = math.cos(math.acos(threshold) / 2 - SLACK)
    inside = np.concatenate([u[k : k + 8192] @ centres.T >= least for k in range(0, len(u), 8192)])
    out, free = [], np.ones(len(u), dtype=bool)
    for k in range(len(centres)):
        members = np.flatnonzero(inside[:, k] & free)
        if len(members) >= KNOT:
            free[members] = False
            out.append((centres[k], members))
    return out


def _to_knot(found: _Found, u: np.ndarray, centre: np.ndarray, members: np.ndarray, others: np.ndarray, threshold: float) -> None:
    """Links ``others`` with the members of a knot."""

    def angles(x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(u[x] @ centre, -1, 1))

    theta, spread, away = math.acos(threshold), angles(members).max(), angles(others)
    with_all = others[away <= theta - spread - SLACK]
    if len(with_all):
        found.links[with_all] += found.size[members].sum()
        found.links[members] += found.size[with_all].sum()
        found.join(with_all, members[:1])
        found.join(members, members[:1])
    some = others[(away > theta - spread - SLACK) & (away <= theta + spread + SLACK)]
    for k in range(0, len(some), 256):
        x, y = np.nonzero(u[some[k : k + 256]] @ u[members].T >= threshold)
        found.add(some[k : k + 256][x], members[y])


#: The place of the first bit that is set in a byte.
FIRST_BIT = np.array([8 - int(x).bit_length() for x in range(256)])


def _by_tails(found: _Found, u: np.ndarray, rows: np.ndarray, own: int | None, planned: tuple[int, float, int], threshold: float, window: float) -> None:
    """Links pairs of ``rows``; those with one end below ``own`` and one from it on, if that is given."""
    order, cut_at, m = planned
    directions, counted = _directions(m, u.shape[1], 1), _directions(COUNTED, u.shape[1], 99)
    single, need = directions.astype(np.float32), demanded()
    flat, across = u.astype(np.float32), np.ascontiguousarray(single.T)
    roughly = np.float32(threshold - u.shape[1] * 2.0**-22)  # single precision errs by less
    bits = np.zeros((len(u), (2 * m + 7) // 8), dtype=np.uint8)  # tails that a vector lies in

    def tails(begin: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(tail, rows in it, how far out) of ``SLAB`` directions, rows from the nearest on."""
        held, n = [], min(SLAB, m - begin)
        for k in range(0, len(rows), 1024):  # few enough to stay in the processor's cache
            p = (flat[rows[k : k + 1024]] @ single[:, begin : begin + n]).ravel()
            at = np.flatnonzero(np.abs(p) >= cut_at)
            row, axis = np.divmod(at, n)
            row, tail = rows[k + row], 2 * (begin + axis) + (p[at] > 0)
            np.bitwise_or.at(bits, (row, tail >> 3), (0x80 >> (tail & 7)).astype(np.uint8))
            held.append((tail, row, np.abs(p[at])))
        tail, row, p = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(tail * 64.0 + p)
        ends = np.cumsum(np.bincount(tail - 2 * begin, minlength=2 * n))
        for t, (i, j) in enumerate(zip([0, *ends[:-1]], ends)):
            yield 2 * begin + t, row[by[i:j]], p[by[i:j]]

    def collide(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether pairs that share a tail are in each other's window there."""
        return np.abs(np.einsum("ij,ij->i", flat[a] - flat[b], across[t >> 1])) <= window

    def enough(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
        """Whether pairs have the last collision that is demanded in this tail, so that each is linked in one."""
        out, count = collide(a, b, np.full(len(a), t)), np.zeros(len(a), dtype=np.int64)
        before = bits[a, : t // 8 + 1] & bits[b, : t // 8 + 1]
        before[:, -1] &= 0xFF ^ (0xFF >> t % 8)
        left = np.flatnonzero(out & before.any(axis=1))
        while len(left):
            byte = (before[left] != 0).argmax(axis=1)
            bit = FIRST_BIT[before[left, byte]]
            count[left] += collide(a[left], b[left], 8 * byte + bit)
            before[left, byte] ^= (0x80 >> bit).astype(np.uint8)
            left = left[count[left] < order]
            left = left[before[left].any(axis=1)]
        return out & (count == order - 1)

    for t, here, at_p in (x for begin in range(0, m, SLAB) for x in tails(begin)):
        if own is None:
            left, right, left_p, right_p = here, here, at_p, at_p
        else:
            low = here < own
            left, right, left_p, right_p = here[low], here[~low], at_p[low], at_p[~low]
        if not len(left) or not len(right):
            continue
        left_u, right_u = flat[left], flat[right].T
        step = max(64, (1 << 17) // len(right))
        for at in range(0, len(left), step):
            stop = min(at + step, len(left))
            lo = at if own is None else int(np.searchsorted(right_p, left_p[at] - window - 1e-3))
            hi = int(np.searchsorted(right_p, left_p[stop - 1] + window + 1e-3, "right"))
            # what is far from the threshold goes first, as one product of matrices costs less than any other look at a pair
            x, y = np.divmod(np.flatnonzero(left_u[at:stop] @ right_u[:, lo:hi] >= roughly), max(1, hi - lo))
            if own is None:
                x, y = x[y > x], y[y > x]
            for k in range(0, len(x), 1 << 13):
                a, b = left[at + x[k : k + (1 << 13)]], right[lo + y[k : k + (1 << 13)]]
                now = enough(a, b, t)
                a, b = a[now], b[now]
                hits = (np.abs((u[a] - u[b]) @ counted) <= window).sum(axis=1)
                linked = (hits >= need) & (np.einsum("ij,ij->i", u[a], u[b]) >= threshold)
                found.add(a[linked], b[linked])


def _compare(u: np.ndarray, size: np.ndarray, own: int | None, planned: tuple[int, float, int], threshold: float, window: float) -> _Found:
    """Links among vectors of one space; only those between the first ``own`` and the others, if that is given."""
    found, free = _Found(size), np.ones(len(u), dtype=bool)
    if own is None:
        for centre, members in _knots(u, threshold):
            found.links[members] += size[members].sum() - size[members]
            found.join(members, members[:1])
            free[members] = False
            _to_knot(found, u, centre, members, np.flatnonzero(free), threshold)
    else:
        for centre, members in _knots(u[:own], threshold):
            free[members] = False
            _to_knot(found, u, centre, members, np.arange(own, len(u)), threshold)
        for centre, members in _knots(u[own:], threshold):
            free[own + members] = False
            _to_knot(found, u, centre, own + members, np.flatnonzero(free[:own]), threshold)
    rows = np.flatnonzero(free)
    if len(rows) > 1:
        _by_tails(found, u, rows, own, planned, threshold, window)
    return found


def _read(path: str, block: int) -> tuple[dict[str, tuple[int, int]], pa.Table] | None:
    """A block's rows by space, and where each space begins and ends."""
    fs, root = pafs.FileSystem.from_uri(f"{path}/block={block}")
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.path.endswith(".parquet")]
    if not files:
        return None
    rows = pa.concat_tables([pq.read_table(x, columns=["rep", "space", "size", "v"], filesystem=fs, partitioning=None) for x in files]).combine_chunks()
    spaces = rows["space"].combine_chunks().dictionary_encode()
    of = spaces.indices.to_numpy()
    ends = np.cumsum(np.bincount(of, minlength=len(spaces.dictionary)))
    where = {space: (int(a), int(b)) for space, a, b in zip(spaces.dictionary.to_pylist(), [0, *ends[:-1]], ends)}
    return where, rows.take(pa.array(np.argsort(of, kind="stable"))).combine_chunks()


def _met(path: str, threshold: float, window: float, plans: list[tuple[int, float, int]]):
    """Compares a block with itself or another: (vec_id, links found here, smallest vec_id joined here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, g in zip(batch["f"].to_pylist(), batch["g"].to_pylist()):
                both = [_read(path, k) for k in dict.fromkeys((f, g))]
                if not all(both):
                    continue
                for space in both[0][0]:
                    some = [rows.slice(where[space][0], where[space][1] - where[space][0]) for where, rows in both if space in where]
                    if len(some) < len(both):
                        continue
                    ids, size = (np.concatenate([x[c].to_numpy() for x in some]) for c in ("rep", "size"))
                    if len(ids) < 2:
                        continue
                    u = np.concatenate([_units(x["v"].combine_chunks()) for x in some])
                    found = _compare(u, size, len(some[0]) if f != g else None, plans[min(len(ids).bit_length(), len(plans) - 1)], threshold, window)
                    rank = np.argsort(ids, kind="stable")
                    least = np.full(len(ids), np.iinfo(np.int64).max)
                    to = found.joined()
                    np.minimum.at(least, to, ids)
                    linked = rank[found.links[rank] > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(found.links[linked]), pa.array(least[to[linked]])], ["vec_id", "n", "root"])

    return run


def _by_id(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes that share an id."""
    me = F.xxhash64("space", "h")
    several = keyed.groupBy("vec_id").agg(F.min(me).alias("lo"), F.max(me).alias("hi")).where("lo != hi").select("vec_id")
    several = stored(several, "several")
    rows = stored(keyed.join(several.hint("merge"), "vec_id", "left_semi").distinct(), "ids-of-several")
    of = join_counted(rows, classes.select("space", "h", "size", "rep"), ["space", "h"], "vec_id", "size").select("vec_id", "rep")
    first = of.groupBy("vec_id").agg(F.min("rep").alias("a"))
    return of.join(first, "vec_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct()


def _blocks(rows: DataFrame, keyed: DataFrame) -> tuple[DataFrame, str, DataFrame, int]:
    """The classes without their vectors, the folder of all blocks, the pairs (f, g) of blocks to compare, and how many pairs.

    A class is a vector of a space; its number, and not an id, names it, because an id may have several vectors. A space of more
    than a block has blocks of its own. Of these there are at most as many as the table fills, so their list is broadcast; smaller
    spaces share blocks of a sixteenth.
    """
    spark = rows.sparkSession
    room = 64 * BLOCK
    weight = F.col("count") * F.substring_index("space", ":", 1).cast("long")
    spaces = stored(keyed.groupBy("space").count().select("space", weight.alias("weight")), "spaces")
    count = F.ceil(F.col("weight") / room).cast("long")
    large = spaces.where(F.col("weight") > room).select("space", count.alias("parts"))
    large = stored(large.withColumn("base", F.sum("parts").over(Window.orderBy("space").rowsBetween(Window.unboundedPreceding, 0)) - F.col("parts")), "large-spaces")
    rest = spaces.where(F.col("weight") <= room).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    own, pairs = large.agg(F.coalesce(F.sum("parts"), F.lit(0)), F.coalesce(F.sum(F.col("parts") * (F.col("parts") + 1) / 2), F.lit(0))).first()
    shared = -(-16 * rest // room)

    classes = rows.groupBy("space", "h").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v")).withColumn("rep", F.monotonically_increasing_id())
    block = F.when(F.col("parts").isNotNull(), F.col("base") + F.pmod("h", "parts")).otherwise(own + F.pmod(F.xxhash64("space"), F.lit(max(1, shared))))
    placed = classes.join(F.broadcast(large), "space", "left").withColumn("block", block).drop("base", "parts")
    path = scratch(spark, "vector-blocks")
    placed.repartition(max(1, own + shared), "block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path).select("space", "h", "least", "size", "rep")

    i, j = (F.explode(F.sequence(F.lit(0) if k is None else F.col(k), F.col("parts") - 1)) for k in (None, "i"))
    of_large = large.withColumn("i", i).withColumn("j", j).select((F.col("base") + F.col("i")).alias("f"), (F.col("base") + F.col("j")).alias("g"))
    return kept, path, of_large.unionByName(spark.range(own, own + shared).select(F.col("id").alias("f"), F.col("id").alias("g"))), int(pairs) + shared


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of one label and one length with a cosine of at least ``threshold`` are linked. Null, zero, empty and non-finite
    vectors and rows without label are linked with nothing and kept. n_links counts the other vectors linked directly;
    component_id is the smallest id reachable. Rows with a null id have no component and are kept. Rows of one id are
    counted as that many vectors, and what any of them reaches is reached by the id.
    """
    rows = _valid(vectors, id_col, vec_col, label_col)
    keyed = stored(rows.drop("v"), "vector-keys")
    classes, path, pairs, tasks = _blocks(rows, keyed)

    window = WIDTH * math.sqrt(2 * (1 - threshold))
    # entry k is for up to 2^k vectors; two full blocks of short vectors hold more, and are compared as the last says
    plans = [plan(1 << k, threshold, window) for k in range((2 * BLOCK).bit_length() + 1)]
    dealt = pairs.repartitionByRange(max(1, min(tasks, 10_000)), "f", "g")
    met = stored(dealt.mapInArrow(_met(path, threshold, window, plans), "vec_id long, n long, root long"), "vector-links")

    edges = met.where("vec_id > root").select(F.col("root").alias("a"), F.col("vec_id").alias("b")).distinct()
    comp = cut(connected_components(edges.unionByName(_by_id(keyed, classes)), "a", "b")).withColumnRenamed("node", "rep")
    more = met.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("c"))
    # whatever has links is in comp
    linked = stored(classes.select("rep", "least").join(comp.join(more, "rep", "left"), "rep"), "linked-classes")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    joined = join_counted(linked, smallest, ["component"], "rep").select("rep", "component_id", "c")
    results = classes.join(joined, "rep", "left").select("space", "h", "size", F.coalesce("component_id", "least").alias("component_id"), (F.col("size") - 1 + F.coalesce("c", F.lit(0))).alias("n_links"))
    placed = stored(results, "class-results")
    found = join_counted(keyed, placed, ["space", "h"], "vec_id", "size").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
