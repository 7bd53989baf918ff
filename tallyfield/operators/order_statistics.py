"""Exact ranks, medians and discordant pairs of any number of rows a key, without a task that orders a whole key.

Equal values are counted first. The counts are laid out by ranges of (key, value); a value's rank is then the rows of its key in
earlier ranges, which a small table of totals tells, plus those before it in its own range. Two such layouts, by x and by y,
give the discordant pairs: those inside a range of x, those inside a range of y, and for the rest the totals of (range of x, range of y).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.session import stored

SMALL = 64  # rows of a group whose pairs are compared inside the row


def positions(rows: DataFrame, value: str, *keys: str, count: str | None = None) -> DataFrame:
    """(keys, value, n, below, total): of each distinct value its rows, the rows of its key that are smaller, and all of the key's.

    A row stands for as many as ``count`` says. Null values are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(count) if count else F.count("*")).alias("n"))
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col(value)]
    laid = stored(counts.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = laid.groupBy(*keys, "__part").agg(F.sum("n").alias("__rows"))  # a row for each range that a key lies in
    w = Window.partitionBy(*keys).orderBy("__part") if keys else Window.partitionBy(F.lit(0)).orderBy("__part")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = parts.withColumns({"__before": F.sum("__rows").over(w) - F.col("__rows"), "total": F.sum("__rows").over(whole)}).drop("__rows")
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    out = _join(placed, offsets, [*keys, "__part"])
    return out.select(*keys, value, "n", (F.col("__before") + F.col("__in")).alias("below"), "total")


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """By keys of which null is one."""
    b = b.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return a.join(b, match, how).drop(*[f"__r{i}" for i in range(len(keys))])


def following(rows: DataFrame, order: str, value: Column, *keys: str, name: str = "following") -> DataFrame:
    """Adds ``value`` of the next row of the same key by ``order`` (null after the last), without a task that orders a whole key.

    Rows are laid out by ranges of (key, order); the last of a range takes the first of the key's next range. ``order`` should name a
    row of its key; rows that share it follow each other in some order.
    """
    by = [*[F.col(k).asc_nulls_first() for k in keys], F.col(order).asc_nulls_first()]
    laid = stored(rows.withColumn("__v", F.struct(value.alias("v"))).repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    firsts = laid.groupBy(*keys, "__part").agg(F.min_by("__v", F.struct(F.col(order).isNotNull(), order)).alias("__first"))
    later = F.lead("__first").over(Window.partitionBy(*keys).orderBy("__part"))  # a row for each range that a key lies in
    inside = F.lead("__v").over(Window.partitionBy(*keys, "__part").orderBy(F.col(order).asc_nulls_first()))
    out = _join(laid.withColumn("__in", inside), firsts.withColumn("__next", later).drop("__first"), [*keys, "__part"], "left")
    return out.select(*rows.columns, F.coalesce("__in", "__next")["v"].alias(name))


def numbered(rows: DataFrame, *order: Column, running: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``number`` (from 1) and ``total``, and sums up to and with each row, in one order over all rows; no task orders them all.

    The order should tell rows apart; rows that share their place are numbered in some order.
    """
    sums = running or {}
    laid = stored(rows.withColumns({f"__{name}": x for name, x in sums.items()}).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    per = laid.groupBy("__part").agg(F.count("*").alias("__rows"), *[F.sum(f"__{name}").alias(f"__all_{name}") for name in sums])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = per.select("__part", before("__rows").alias("__first"), F.sum("__rows").over(Window.partitionBy(F.lit(1))).alias("total"), *[before(f"__all_{name}").alias(f"__before_{name}") for name in sums])
    own = Window.partitionBy("__part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(F.broadcast(offsets), "__part")  # a row for each range
    return out.select(*rows.columns, (F.row_number().over(own) + F.col("__first")).alias("number"), "total", *[(F.coalesce(F.sum(f"__{name}").over(upto), F.lit(0)) + F.col(f"__before_{name}")).alias(name) for name in sums])


def medians(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, median): the middle value of each key, or the mean of the two."""
    p = positions(rows, value, *keys)
    holds = lambda k: (F.col("below") < k) & (k <= F.col("below") + F.col("n"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    x = F.col(value).cast("double")
    middle = p.where(holds(low) | holds(high)).groupBy(*keys).agg((F.max(F.when(holds(low), x)) + F.max(F.when(holds(high), x))).alias("s"))
    return middle.select(*keys, (F.col("s") / 2).alias("median"))


def centers(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, center, mad): the median and the median distance from it."""
    m = stored(medians(rows, value, *keys).withColumnRenamed("median", "center"), "centers")
    counts = rows.where(F.col(value).isNotNull()).select(*keys, value)
    apart = _join(counts, m, list(keys)).withColumn("__d", F.abs(F.col(value) - F.col("center")))
    return _join(m, medians(apart, "__d", *keys).withColumnRenamed("median", "mad"), list(keys))


def rank_correlation(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, n, spearman) of rows with both values: the correlation of average ranks; null under two rows or without variance.

    Twice the rank's distance from the key's mean is a whole number, so the sums do not depend on their order up to 2^53.
    """
    pairs = stored(rows.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("c")), "pairs")
    spread = lambda value, name: positions(pairs, value, *keys, count="c").select(*keys, value, (2 * F.col("below") + F.col("n") - F.col("total")).cast("double").alias(name), "total")
    both = _join(_join(pairs, spread(x, "__a"), [*keys, x]), spread(y, "__b").drop("total"), [*keys, y])
    s = both.groupBy(*keys).agg(F.max("total").alias("n"), F.sum(F.col("c") * F.col("__a") * F.col("__b")).alias("ab"), F.sum(F.col("c") * F.col("__a") * F.col("__a")).alias("aa"), F.sum(F.col("c") * F.col("__b") * F.col("__b")).alias("bb"))
    return s.select(*keys, "n", F.when(F.col("n") > 1, F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb"))).alias("spearman"))


def weighted_inversions(values: np.ndarray, weights: np.ndarray, blocks: np.ndarray | None = None) -> float:
    """Sum of weight products over pairs in which an earlier value is larger; with ``blocks``, only of pairs from different ones.

    Runs are merged by width; a right run's values look up the weight of the larger ones on their left.
    """

    def count(v: np.ndarray, w: np.ndarray) -> float:
        total, width = 0.0, 1
        v = np.unique(v, return_inverse=True)[1].astype(np.int64)
        span = int(v.max(initial=0)) + 1
        while width < len(v):
            run, right = np.arange(len(v)) // (2 * width), np.arange(len(v)) // width % 2 == 1
            keys = run * span + v
            left = keys[~right]
            sums = np.concatenate([[0.0], np.cumsum(w[~right])])
            ends = np.searchsorted(left, (run[right] + 1) * span)
            total += float((w[right] * (sums[ends] - sums[np.searchsorted(left, keys[right], "right")])).sum())
            order = np.argsort(keys, kind="stable")
            v, w, width = v[order], w[order], 2 * width
        return total

    every = count(values, weights)
    if blocks is None or not len(values):
        return every
    order = np.argsort(blocks, kind="stable")
    edges = np.flatnonzero(np.diff(blocks[order])) + 1
    return every - sum(count(values[part], weights[part]) for part in np.split(order, edges))


def discordant(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, discordant): weighted pairs in which x and y disagree, from (keys, x, y, c) rows that are distinct in (keys, x, y)."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    out = f"{kinds}, d double"
    by = lambda *cs: [F.col(c).asc_nulls_first() for c in (*keys, *cs)]
    laid = stored(rows.repartitionByRange(*by(x, y)).withColumn("__xp", F.spark_partition_id()), "by-x")
    both = stored(laid.repartitionByRange(*by(y, x)).withColumn("__yp", F.spark_partition_id()), "by-y")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y])
        return pdf.iloc[:1][[*keys]].assign(d=weighted_inversions(pdf[y].to_numpy(), pdf["c"].to_numpy(dtype=float)))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__xp", x, y])
        return pdf.iloc[:1][[*keys]].assign(d=weighted_inversions(pdf[y].to_numpy(), pdf["c"].to_numpy(dtype=float), pdf["__xp"].to_numpy()))

    def between(pdf: pd.DataFrame) -> pd.DataFrame:  # a row for each range of x and range of y that the key lies in
        table = pdf.pivot_table(index="__xp", columns="__yp", values="c", aggfunc="sum", fill_value=0).sort_index().sort_index(axis=1).to_numpy(dtype=float)
        larger = table[:, ::-1].cumsum(axis=1)[:, ::-1]  # in this range of x, in this range of y or later
        earlier = np.vstack([np.zeros(table.shape[1]), larger.cumsum(axis=0)[:-1]])
        later = np.hstack([earlier[:, 1:], np.zeros((len(table), 1))])
        return pdf.iloc[:1][[*keys]].assign(d=float((table * later).sum()))

    totals = both.groupBy(*keys, "__xp", "__yp").agg(F.sum("c").alias("c"))
    parts = both.groupBy(*keys, "__xp").applyInPandas(inside, out).unionByName(both.groupBy(*keys, "__yp").applyInPandas(across, out)).unionByName(totals.groupBy(*keys).applyInPandas(between, out))
    return parts.groupBy(*keys).agg(F.sum("d").alias("discordant"))


def kendall(rows: DataFrame, x: str, y: str, *keys: str, small: int = SMALL) -> DataFrame:
    """(keys, tau_b) of rows with both values; null when one side is all ties.

    The pairs of a key with up to ``small`` rows are compared inside one row; larger keys go through ranges.
    """
    if not keys:
        return kendall(rows.withColumn("__all", F.lit(1)), x, y, "__all", small=small).drop("__all")
    values = rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    counted = values.groupBy(*keys).agg(F.count("*").alias("m"))
    sizes = counted.where(F.col("m") > small)
    if sizes.isEmpty():
        return _inside(values, keys)
    large = stored(sizes.drop("m"), "large")
    return _inside(_join(values, large, list(keys), "left_anti"), keys).unionByName(_ranged(_join(values, large, list(keys), "left_semi"), keys))


def _tau(n: Column, tx: Column, ty: Column, txy: Column, d: Column) -> Column:
    """From all pairs, those tied in x, in y, in both, and the discordant ones."""
    free = (n - tx) * (n - ty)
    return F.when(free > 0, (n - tx - ty + txy - 2 * d) / F.sqrt(free))


def _inside(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    per = values.groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("p"), F.count("*").cast("double").alias("m"))
    of = lambda test: F.aggregate(F.transform("p", lambda a, i: F.size(F.filter("p", lambda b, j: (j > i) & test(a, b)))), F.lit(0), lambda s, k: s + k).cast("double")
    same_x, same_y = (lambda a, b: a["x"] == b["x"]), (lambda a, b: a["y"] == b["y"])
    d = of(lambda a, b: ((a["x"] < b["x"]) & (a["y"] > b["y"])) | ((a["x"] > b["x"]) & (a["y"] < b["y"])))
    n = F.col("m") * (F.col("m") - 1) / 2
    return per.select(*keys, _tau(n, of(same_x), of(same_y), of(lambda a, b: same_x(a, b) & same_y(a, b)), d).alias("tau_b"))


def _ranged(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    pairs = stored(values.groupBy(*keys, "x", "y").agg(F.count("*").alias("c")), "pairs")
    two = lambda c: F.sum(c * (c - 1) / 2)
    ties = lambda side, name: pairs.groupBy(*keys, side).agg(F.sum("c").alias("t")).groupBy(*keys).agg(two(F.col("t")).alias(name))
    whole = pairs.groupBy(*keys).agg(F.sum("c").cast("double").alias("m"), two(F.col("c")).alias("txy"))
    d = whole
    for other in (ties("x", "tx"), ties("y", "ty"), discordant(pairs, "x", "y", *keys)):
        d = _join(d, other, list(keys))
    n = F.col("m") * (F.col("m") - 1) / 2
    return d.select(*keys, _tau(n, F.col("tx"), F.col("ty"), F.col("txy"), F.col("discordant")).alias("tau_b"))
