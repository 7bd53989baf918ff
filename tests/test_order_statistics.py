import math
import random
from statistics import median

import numpy as np
import pytest

from tallyfield.operators import order_statistics as os_


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some(seed, n=900, distinct=40):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None, "c"]), float(r.randint(0, distinct)), float(r.randint(0, distinct)) if r.random() < 0.95 else None) for _ in range(n)]
    return [(k, x, (y + x) // 2 if y is not None and k == "a" else y) for k, x, y in rows] + [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("none", 1.0, None)]


def grouped(rows):
    out = {}
    for k, x, y in rows:
        out.setdefault(k, []).append((x, y))
    return out


def tau(pairs):
    c = d = tx = ty = 0
    for i in range(len(pairs)):
        for j in range(i):
            a, b = pairs[i][0] - pairs[j][0], pairs[i][1] - pairs[j][1]
            c, d, tx, ty = c + (a * b > 0), d + (a * b < 0), tx + (a != 0), ty + (b != 0)
    return (c - d) / math.sqrt(tx * ty) if tx * ty else None


@pytest.mark.parametrize("small", [0, 64, 10_000])
def test_kendall(spark, many_tasks, small):
    rows = some(1)
    got = {r.k: r.tau_b for r in os_.kendall(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", "k", small=small).collect()}
    want = {k: tau([p for p in ps if p[1] is not None]) for k, ps in grouped(rows).items() if any(p[1] is not None for p in ps)}
    assert got.keys() == want.keys()
    assert all(got[k] is None if want[k] is None else abs(got[k] - want[k]) < 1e-12 for k in want)


def test_kendall_without_keys(spark, many_tasks):
    pairs = [(x, y) for _, x, y in some(2, 500, 2000) if y is not None]
    got = os_.kendall(spark.createDataFrame(pairs, "x double, y double"), "x", "y", small=10).collect()
    assert len(got) == 1 and abs(got[0].tau_b - tau(pairs)) < 1e-12


def test_positions_medians_and_centers(spark, many_tasks):
    rows = some(3)
    df = spark.createDataFrame(rows, "k string, x double, y double")
    by = grouped(rows)
    for r in os_.positions(df, "x", "k").collect():
        xs = [x for x, _ in by[r.k]]
        assert (r.n, r.below, r.total) == (xs.count(r.x), sum(x < r.x for x in xs), len(xs))
    got = {r.k: (r.center, r.mad) for r in os_.centers(df, "y", "k").collect()}
    for k, ps in by.items():
        ys = [y for _, y in ps if y is not None]
        if ys:
            m = median(ys)
            assert got.pop(k) == (m, median(abs(y - m) for y in ys))
    assert not got
    assert os_.medians(df, "x").collect()[0].median == median(x for _, x, _ in rows)


def test_rank_correlation(spark, many_tasks):
    rows = some(5)
    got = {r.k: (r.n, r.spearman) for r in os_.rank_correlation(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", "k").collect()}
    for k, ps in grouped(rows).items():
        ps = [p for p in ps if p[1] is not None]
        rank = lambda v: np.array([sum(a < b for a in v) + (v.count(b) + 1) / 2 for b in v])
        a, b = (rank([p[i] for p in ps]) for i in (0, 1))
        want = float(np.corrcoef(a, b)[0, 1]) if len(ps) > 1 and a.std() and b.std() else None
        if ps:
            assert got[k][0] == len(ps) and (got[k][1] is None if want is None else abs(got[k][1] - want) < 1e-9)


def test_no_task_orders_a_whole_key(spark):
    df = spark.createDataFrame(some(6), "k string, x double, y double")
    for plan in (os_.centers(df, "y", "k"), os_.rank_correlation(df, "x", "y", "k"), os_.kendall(df, "x", "y", "k", small=0)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in text and "CartesianProduct" not in text
        windows = [line for line in text.splitlines() if " Window " in line]
        assert all("__part" in line for line in windows)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double, y double")
    assert os_.kendall(df, "x", "y", "k").collect() == os_.centers(df, "x", "k").collect() == os_.rank_correlation(df, "x", "y", "k").collect() == []


def test_following(spark, many_tasks):
    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = [(r.choice("aaab") if i % 50 else None, i, f"v{i}") for i in r.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    got = {(x.k, x.i): x.n for x in os_.following(df, "i", F.col("v"), "k", name="n").collect()}
    by = {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        by.setdefault(k, []).append((i, v))
    want = {(k, i): nxt[1] if nxt else None for k, xs in by.items() for (i, _), nxt in zip(xs, [*xs[1:], None])}
    assert got == want


def test_numbered(spark, many_tasks):
    from pyspark.sql import functions as F

    r = random.Random(11)
    rows = [(r.choice([0.5, 0.5, r.random()]), i, r.random() < 0.3) for i in range(900)]
    got = os_.numbered(spark.createDataFrame(rows, "c double, i int, bad boolean"), F.desc("c"), F.asc("i"), running={"w": F.col("bad").cast("int")}).orderBy("number").collect()
    want = sorted(rows, key=lambda x: (-x[0], x[1]))
    assert [(x.c, x.i, x.bad) for x in got] == want and [x.number for x in got] == list(range(1, 901)) and {x.total for x in got} == {900}
    assert [x.w for x in got] == list(np.cumsum([x[2] for x in want]))
    assert os_.numbered(spark.createDataFrame([], "c double"), F.asc("c")).collect() == []
