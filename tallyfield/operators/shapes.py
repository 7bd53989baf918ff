"""Non-linear pairwise models: monotone splines, and boosted stumps and trees from histograms."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.components import connected_components
from tallyfield.operators.corpus import unit
from tallyfield.operators.models import LOCAL, at_ends, end_differences, end_items, logistic_sums, pair_ends, whole_pairs
from tallyfield.session import stored

SHRINKAGE = 0.15
BINS = 256


def isotonic(values: list[float], weights: list[float] | None = None, direction: int = 1) -> list[float]:
    """Closest monotone values by pooling neighbours; direction 0 leaves them alone. For a handful of numbers."""
    if direction == 0:
        return list(values)
    pools: list[list[float]] = []
    for v, w in zip(values, weights or [1.0] * len(values)):
        pools.append([v * direction, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [p[0] * direction for p in pools for _ in range(int(p[2]))]


def knots(records: DataFrame, features: list[str], most: int = 5) -> dict[str, list[float]]:
    """At most ``most`` evenly spaced positions among each feature's distinct values; a constant gets a window around it.

    Up to 10,000 distinct values the positions are exact, beyond that approximate percentiles of the distinct values.
    """
    out = {}
    for f in features:
        distinct = records.select(F.col(f).cast("double").alias("v")).where("v is not null").distinct()
        n = distinct.count()
        at = [i / (min(most, n) - 1) for i in range(min(most, n))] if n > 1 else []
        how = F.percentile if n <= 10_000 else F.percentile_approx
        found = distinct.agg(how("v", at)).first()[0] if at else [r[0] for r in distinct.collect()]
        out[f] = sorted(set(found)) if len(set(found)) > 1 else [(found or [0.0])[0] - 1, (found or [0.0])[0] + 1]
    return out


def hats(x: Column, at: list[float]) -> list[Column]:
    """Weights of each knot at x: the two neighbours share 1, outside the last knot has it all, null has none."""
    out = []
    for i, k in enumerate(at):
        w = F.lit(0.0)
        if i:
            w = F.when((x >= at[i - 1]) & (x < k), (x - at[i - 1]) / (k - at[i - 1])).otherwise(w)
        if i + 1 < len(at):
            w = F.when((x >= k) & (x < at[i + 1]), (at[i + 1] - x) / (at[i + 1] - k)).otherwise(w)
        w = F.when((x < k) if i == 0 else (x >= k) if i == len(at) - 1 else F.lit(False), 1.0).otherwise(w)
        out.append(F.when(x.isNull(), 0.0).otherwise(w))
    return out


def fit_pairwise_gam(pairs: DataFrame, records: DataFrame, directions: dict[str, int], most_knots: int = 5, l2: float = 0.01, rate: float = 0.5, iterations: int = 500, tolerance: float = 1e-7, ended: DataFrame | None = None) -> dict[str, list[tuple[float, float]]]:
    """(x, y) knots per feature of a sum of monotone piecewise linear curves; gradient steps as for the linear model.

    The hat weights of both ends of a pair are columns computed once; a step is one aggregate, and its projection pools at most
    ``most_knots`` numbers for each feature. ``ended`` are the pairs with their ends, where these are joined already.
    """
    at = knots(records, list(directions), most_knots)
    names = {f: [f"__{f}_{i}" for i in range(len(at[f]))] for f in directions}
    basis = {n: w for f in directions for n, w in zip(names[f], hats(F.col(f).cast("double"), at[f]))}
    flat = [n for f in directions for n in names[f]]
    diffs = end_differences(pair_ends(pairs, records, list(directions)) if ended is None else ended, basis).persist()
    y, before = dict.fromkeys(flat, 0.0), None
    try:
        n = diffs.count()
        sums = logistic_sums(diffs, flat) if n else None
        for _ in range(iterations if n else 0):
            row = sums(y)
            for k, g in zip(flat, row[1:]):
                y[k] -= rate * (g / n + l2 * y[k])
            for f, d in directions.items():
                y.update(zip(names[f], isotonic([y[k] for k in names[f]], direction=d)))
            loss = row[0] / n
            if before is not None and abs(before - loss) < tolerance:
                break
            before = loss
    finally:
        diffs.unpersist()
    return {f: [(x, y[k]) for x, k in zip(at[f], names[f])] for f in directions}


@dataclass(frozen=True)
class Stump:
    """low where the feature is at most the threshold, high above, nothing where it is missing."""

    feature: str
    threshold: float
    low: float
    high: float

    def column(self, prefix: str = "") -> Column:
        x = F.col(f"{prefix}{self.feature}")
        return F.when(x <= self.threshold, self.low).when(x > self.threshold, self.high).otherwise(0.0)


def thresholds(records: DataFrame, feature: str, bins: int = BINS) -> list[float]:
    """Midpoints between neighbouring distinct values, or ``bins`` approximate percentiles when there are more."""
    v = records.select(F.col(feature).cast("double").alias("v")).where("v is not null").distinct()
    few = sorted(r[0] for r in v.limit(bins + 1).collect())
    if len(few) > bins:
        return sorted(set(v.agg(F.percentile_approx("v", [i / bins for i in range(1, bins)])).first()[0]))
    return [(a + b) / 2 for a, b in zip(few, few[1:])]


def bin_column(f: str, cuts: list[float]) -> Column:
    """How many cuts lie below a value: its bin; null for a missing value."""
    x = F.col(f).cast("double")
    below = F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < x)
    return F.when(x.isNotNull(), F.size(below) if cuts else F.lit(0))


def best_stump(histogram: dict[str, dict[int, tuple[float, float]]], cuts: dict[str, list[float]], directions: dict[str, int], min_leaf: int) -> tuple[float, Stump] | None:
    """The split with the largest gain from (items, sum of targets) by feature and bin; ties by name, then threshold."""
    found = None
    for f, bins in histogram.items():
        total_n, total_s = sum(n for n, _ in bins.values()), sum(s for _, s in bins.values())
        n = s = 0
        for b, cut in enumerate(cuts[f]):
            n, s = n + bins.get(b, (0, 0.0))[0], s + bins.get(b, (0, 0.0))[1]
            if n < min_leaf or total_n - n < min_leaf:
                continue
            low, high = isotonic([s / n, (total_s - s) / (total_n - n)], [1.0, 1.0], directions[f])
            gain = 2 * (low * s + high * (total_s - s)) - (low * low * n + high * high * (total_n - n))
            if found is None or (gain, f, cut) > (found[0], found[1].feature, found[1].threshold):
                found = (gain, Stump(f, cut, low, high))
    return found


def linked_groups(ended: DataFrame, group: str) -> DataFrame:
    """(g, component): the games that a pair connects with another game, and the smallest game that each is connected with."""
    across = ended.select(F.col("left")[group].alias("left_g"), F.col("right")[group].alias("right_g")).where("left_g != right_g").distinct()
    return connected_components(across, "left_g", "right_g").withColumnRenamed("node", "g")


def _keyed(rows: DataFrame, game: Column, linked: DataFrame) -> DataFrame:
    """Adds ``__k``: the game or, where pairs connect it with others, the smallest of these."""
    smallest = linked.select(F.col("g").alias("__g"), F.col("component").alias("__c"))
    return rows.withColumn("__g", game).join(smallest, "__g", "left").withColumn("__k", F.coalesce("__c", "__g")).drop("__g", "__c")


def _stop(share: float = 0.2, seed: str = "0") -> Column:
    return unit(F.concat_ws(":", F.lit(seed), F.col("__k").cast("string"))) < share


def _few(keyed: DataFrame, at_least: int = 4) -> bool:
    return keyed.select("__k").distinct().limit(at_least).count() < at_least


def stop_groups(pairs: DataFrame, records: DataFrame, group: str, share: float = 0.2, at_least: int = 4, seed: str = "0") -> DataFrame:
    """(item_ref, stop): items whose games are set aside. Games that a pair connects are set aside together, by hash."""
    keyed = _keyed(records.select("item_ref", F.col(group).alias("of")), F.col("of"), linked_groups(pair_ends(pairs, records, [group]), group))
    return keyed.select("item_ref", (F.lit(not _few(keyed, at_least)) & _stop(share, seed)).alias("stop"))


class _Rounds:
    """Sums over pairs of binned items, equal pairs once with their number; on the driver up to ``LOCAL`` different ones."""

    def __init__(self, binned: DataFrame, features: list[str]) -> None:
        self.features = features
        names = [f"{side}_{f}" for side in ("left", "right") for f in features]
        self.table = binned.groupBy("target", "weight", "stop", *names).agg(F.count("*").alias("n")).persist()
        self.local = self.table.toPandas() if self.table.count() <= LOCAL else None
        if self.local is not None:
            self.bins = {n: self.local[n].fillna(-1).to_numpy(dtype=int) for n in names}
            self.target, self.weight, self.n = (self.local[c].to_numpy(dtype=float) for c in ("target", "weight", "n"))
            self.stop = self.local["stop"].to_numpy(dtype=bool)

    def __call__(self, curves: dict[str, list[float]]) -> tuple[dict[bool, tuple[float, float]], dict[str, dict[int, float]]]:
        """((loss, pairs) by stop, pull by feature and bin) of the scores that ``curves`` give each bin."""
        if self.local is None:
            return self._cluster(curves)
        score = lambda side: sum(np.append(curves[f], 0.0)[self.bins[f"{side}_{f}"]] for f in self.features)
        p = 1 / (1 + np.exp(np.clip(score("right") - score("left"), -700, 700)))
        safe = np.clip(p, 1e-9, 1 - 1e-9)
        loss = -self.weight * self.n * (self.target * np.log(safe) + (1 - self.target) * np.log(1 - safe))
        losses = {k: (float(loss[self.stop == k].sum()), float(self.n[self.stop == k].sum())) for k in (False, True)}
        e = np.where(self.stop, 0.0, (p - self.target) * self.weight * self.n)
        pull: dict[str, dict[int, float]] = {}
        for f in self.features:
            size = len(curves[f]) + 1
            both = np.bincount(self.bins[f"right_{f}"] + 1, e, size) - np.bincount(self.bins[f"left_{f}"] + 1, e, size)
            pull[f] = {b: float(x) for b, x in enumerate(both[1:])}
        return losses, pull

    def _cluster(self, curves: dict[str, list[float]]) -> tuple[dict[bool, tuple[float, float]], dict[str, dict[int, float]]]:
        one = lambda side, f: F.coalesce(F.get(F.array(*[F.lit(float(y)) for y in curves[f]]), F.col(f"{side}_{f}")), F.lit(0.0))
        score = lambda side: sum((one(side, f) for f in self.features), F.lit(0.0))
        rated = self.table.withColumn("p", 1 / (1 + F.exp(score("right") - score("left")))).withColumn("safe", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("p"))))
        entropy = -(F.col("target") * F.log("safe") + (1 - F.col("target")) * F.log(1 - F.col("safe")))
        losses = {False: (0.0, 0.0), True: (0.0, 0.0)} | {r["stop"]: (r["loss"], float(r["pairs"])) for r in rated.groupBy("stop").agg(F.sum(entropy * F.col("weight") * F.col("n")).alias("loss"), F.sum("n").alias("pairs")).collect()}
        e = (F.col("p") - F.col("target")) * F.col("weight") * F.col("n")
        ends = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"{side}_{f}").alias("b"), (e * sign).alias("x")) for f in self.features for side, sign in (("left", -1), ("right", 1))])
        pull: dict[str, dict[int, float]] = {f: {} for f in self.features}
        for r in rated.where("not stop").select(F.explode(ends).alias("e")).where("e.b is not null").groupBy("e.f", "e.b").agg(F.sum("e.x").alias("x")).collect():
            pull[r["f"]][r["b"]] = r["x"]
        return losses, pull


def _binned_pairs(ended: DataFrame, bins: dict[str, Column], tie_weight: float, group: str | None, stops: DataFrame | None) -> DataFrame:
    pairs = at_ends(whole_pairs(ended), bins)
    if stops is not None:  # both ends are in one group
        pairs = _keyed(pairs, F.col("left")[group], stops)
    target = F.when(F.col("choice") == "left", 1.0).when(F.col("choice") == "right", 0.0).when(F.col("choice") == "tie", 0.5)
    weight = F.when(F.col("choice") == "tie", tie_weight).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))) if "confidence" in pairs.columns else 1.0)
    return pairs.withColumns({"target": target, "weight": weight, "stop": _stop() if stops is not None else F.lit(False)}).where("target is not null")


def fit_boosted_stumps(pairs: DataFrame, records: DataFrame, directions: dict[str, int], rounds: int = 100, min_leaf: int = 3, min_gain: float = 1e-9, tolerance: float = 1e-7, tie_weight: float = 0.5, group: str | None = None, patience: int = 5, ended: DataFrame | None = None) -> list[Stump]:
    """Monotone stumps added one by one to the negative pairwise gradient of every item.

    A score depends on an item's bins alone, so the fit needs only how many pairs there are of each two sets of bins; these
    are counted once. A round sums them per (feature, bin). With ``group``, the items' game, a fifth of the connected games is
    set aside; the fit ends after ``patience`` rounds in which their loss does not fall, and goes back to where it was lowest.
    ``ended`` are the pairs with features and game of their ends, where these are joined already.
    """
    features = list(directions)
    if ended is None:
        ended = pair_ends(pairs, records, list(dict.fromkeys([*features, *([group] if group else [])])))
        ended = stored(ended, "ended") if group else ended  # read twice
    cuts = {f: thresholds(records, f) for f in features}
    bins = {f: bin_column(f, cuts[f]) for f in features}
    stops, used = None, records
    if group:
        stops = stored(linked_groups(ended, group), "stops")  # small where pairs lie inside games, and then it is broadcast
        keyed = _keyed(records, F.col(group), stops)
        stops, used = (None, records) if _few(keyed) else (stops, keyed.where(~_stop()))
    counts: dict[str, dict[int, int]] = {f: {} for f in features}
    for r in used.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), c.alias("b")) for f, c in bins.items()])).alias("x")).where("x.b is not null").groupBy("x.f", "x.b").count().collect():
        counts[r["f"]][r["b"]] = r["count"]  # a row for each feature and bin
    sums = _Rounds(_binned_pairs(ended, bins, tie_weight, group, stops), features)
    curves = {f: [0.0] * (len(cuts[f]) + 1) for f in features}
    stumps: list[Stump] = []
    before, lowest, kept = None, None, 0
    try:
        losses, pull = sums(curves)
        if not losses[False][1]:
            return []
        apart = group is not None and losses[True][1] > 0
        lowest = losses[True][0]
        for _ in range(rounds):
            found = best_stump({f: {b: (n, pull[f].get(b, 0.0)) for b, n in counts[f].items()} for f in features}, cuts, directions, min_leaf)
            if found is None or found[0] <= min_gain:
                break
            s = found[1]
            s = Stump(s.feature, s.threshold, s.low * SHRINKAGE, s.high * SHRINKAGE)
            stumps.append(s)
            at = cuts[s.feature].index(s.threshold)
            curves[s.feature] = [y + (s.low if b <= at else s.high) for b, y in enumerate(curves[s.feature])]
            loss = losses[False][0] / losses[False][1]
            losses, pull = sums(curves)
            if apart and losses[True][0] < lowest:
                lowest, kept = losses[True][0], len(stumps)
            elif apart and len(stumps) - kept >= patience:
                break
            if before is not None and abs(before - loss) < tolerance:
                break
            before = loss
    finally:
        sums.table.unpersist()
    return stumps[:kept] if apart else stumps


@dataclass(frozen=True)
class Node:
    """A leaf's value, or a split: at most the threshold goes low, above it high, a missing feature ends in 0."""

    value: float
    feature: str | None = None
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        x = F.col(self.feature)
        return F.when(x <= self.threshold, self.low.column()).when(x > self.threshold, self.high.column()).otherwise(0.0)

    def size(self) -> int:
        return 1 if self.feature is None else 1 + self.low.size() + self.high.size()


def _clip(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def best_split(histogram: dict[str, dict[int, tuple[float, float, float]]], whole: tuple[float, float, float], cuts: dict[str, list[float]], directions: dict[str, int], min_leaf: int, bounds: tuple[float, float]):
    """(gain, feature, cut, bounds below, bounds above) of the best bounded split of a node, from (items, sum, squares) a bin."""
    low, high = bounds
    n, s, q = whole
    value = _clip(s / n, low, high)
    parent, found = q - 2 * value * s + n * value * value, None
    for f, bins in histogram.items():
        total = [sum(x[i] for x in bins.values()) for i in range(3)]
        below = [0.0, 0.0]
        for b, cut in enumerate(cuts[f]):
            below = [below[i] + bins.get(b, (0, 0.0, 0.0))[i] for i in range(2)]
            above = [total[i] - below[i] for i in range(2)]
            if below[0] < min_leaf or above[0] < min_leaf:
                continue
            means = [below[1] / below[0], above[1] / above[0]]
            middle = _clip(sum(means) / 2, low, high)
            sides = ((low, middle), (middle, high)) if directions[f] > 0 else ((middle, high), (low, middle)) if directions[f] < 0 else ((low, high), (low, high))
            a, c = (_clip(m, *side) for m, side in zip(means, sides))
            gain = parent - (total[2] - 2 * a * below[1] + below[0] * a * a - 2 * c * above[1] + above[0] * c * c)
            if found is None or (gain, f, cut) > found[:3]:
                found = (gain, f, cut, *sides)
    return found


def fit_monotone_tree(pairs: DataFrame, records: DataFrame, directions: dict[str, int], max_depth: int = 3, min_leaf: int = 4, min_gain: float = 1e-9, tie_weight: float = 0.5, drawn: DataFrame | None = None) -> Node:
    """A tree on every item's pairwise gradient at score 0; children's values stay inside intervals that keep it monotone.

    A level is one job: items are grouped by (node, feature, bin) to (items, sum, squares). Only these histograms, at most
    ``BINS`` rows for each feature and node, reach the driver. Records count the items, and the items that pairs name (``drawn``, where
    ``end_items`` has made them already) add the sums, so the two are not joined; equal rows are added up once.
    """
    features = list(directions)
    cuts = {f: thresholds(records, f) for f in features}
    if drawn is None:
        drawn = stored(end_items(pair_ends(pairs, records, features), features, tie_weight), "items")
    drawn = drawn.where("t is not null")
    if drawn.limit(1).count() == 0:
        return Node(0.0)
    binned = [bin_column(f, cuts[f]).alias(f) for f in features]
    both = records.select(*binned, F.lit(0.0).alias("t"), F.lit(1).alias("__n"), F.lit(0).alias("__m")).unionByName(drawn.select(*binned, "t", F.lit(0).alias("__n"), F.lit(1).alias("__m")))
    items = both.groupBy(*features, "t").agg(F.sum("__n").alias("__n"), F.sum("__m").alias("__m")).persist()
    # places of open nodes: bits of the way down, and how to get there
    open_: dict[int, tuple[tuple[float, float], Column]] = {1: ((-math.inf, math.inf), F.lit(True))}
    made: dict[int, tuple] = {}
    try:
        for depth in range(max_depth + 1):
            if not open_:
                break
            place = F.coalesce(*[F.when(where, F.lit(k)) for k, (_, where) in open_.items()])
            each = F.array(F.struct(F.lit("").alias("f"), F.lit(0).alias("b")), *[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features])
            t = F.col("t") * F.col("__m")
            rows = items.select(place.alias("k"), F.col("__n").alias("n"), t.alias("s"), (t * F.col("t")).alias("q"), F.explode(each).alias("x")).where("k is not null and x.b is not null").groupBy("k", "x.f", "x.b").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect()
            by: dict[int, dict[str, dict[int, tuple]]] = {}
            for k, f, b, *sums in rows:
                by.setdefault(k, {}).setdefault(f, {})[b] = tuple(sums)
            now, open_ = open_, {}
            for k, (bounds, where) in now.items():
                whole = by[k].pop("")[0]
                value = _clip(whole[1] / whole[0], *bounds)
                found = best_split(by[k], whole, cuts, directions, min_leaf, bounds) if depth < max_depth and whole[0] >= 2 * min_leaf else None
                if found is None or found[0] <= min_gain:
                    made[k] = (value, None, 0.0)
                    continue
                _, f, cut, below, above = found
                made[k] = (value, f, cut)
                at = cuts[f].index(cut)
                open_[2 * k] = (below, where & (F.col(f) <= at))
                open_[2 * k + 1] = (above, where & (F.col(f) > at))
    finally:
        items.unpersist()

    def node(k: int) -> Node:
        value, f, cut = made[k]
        return Node(value) if f is None else Node(value, f, cut, node(2 * k), node(2 * k + 1))

    return node(1)


def shape_score(stumps: list[Stump]) -> Column:
    return sum((s.column() for s in stumps), F.lit(0.0))


def parameters(model: dict | list | Node) -> int:
    """Numbers that a model has: knots, three for each stump, or the nodes of a tree."""
    if isinstance(model, Node):
        return model.size()
    return sum(len(k) for k in model.values()) if isinstance(model, dict) else 3 * len(model)
