import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import hard_negatives as hn
from tallyfield.llm.registry import QUERIES, SQL
from tests.oracle import compare


def brute(rows):
    """Dealt result of (vec_id, label, vector) rows."""
    good = set()
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a, label, v in good:
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, own, w in good if i != a)
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(n, -t) for t, n, own in scored if own != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, i, rank + 1, n, -s, t) for rank, (n, t) in enumerate(fits)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, leaf string, score int")
    got = hn.mine(hn.relabelled(hn.quantised(df)), F.col("vec_id") % 50 == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("leaf, cell, block", [(1024, 4096, 2048), (20, 16, 5)])
def test_equals_brute_force(spark, monkeypatch, leaf, cell, block):
    for name, value in (("LEAF", leaf), ("CELL", cell), ("BLOCK", block)):
        monkeypatch.setattr(hn, name, value)
    r = np.random.default_rng(4)
    centres = r.standard_normal((12, 8))
    v = centres[r.integers(0, 12, 700)] + 0.3 * r.standard_normal((700, 8))
    v[r.integers(0, 700, 200)] = v[3]  # one vector of many ids and labels
    rows = [(i, int(r.integers(0, 10)), (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]
    rows += [rows[50], rows[100], (150, 3, rows[9][2]), (51, 4, rows[50][2])]  # repeated rows; ids with a second vector
    rows += [(None, 1, rows[0][2]), (5000, None, rows[0][2]), (5050, 1, None), (5100, 1, [float("nan")] * 8), (5150, 1, [1.0] * 7 + [None]), (5200, 1, [float("inf")] * 8)]
    rows += [(5250, 2, [0.0] * 8), (5300, 2, []), (5350, 2, [1.0, -1.0])]
    want = brute(rows)
    assert len(want) > 100 and run(spark, rows) == want


def test_whole_table_equals_sql_with_small_leaves(spark, monkeypatch):
    for name, value in (("LEAF", 30), ("CELL", 16), ("BLOCK", 4)):
        monkeypatch.setattr(hn, name, value)
    assert compare(spark, QUERIES["op11_hard_negatives"], SQL["op11_hard_negatives"], "/root/testdata/sf0.01") > 100


def test_the_tree_eliminates_and_loses_nothing():
    r = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(r.standard_normal((20, 6)), 100, axis=0) + 0.05 * r.standard_normal((2000, 6))))
    top = float((x * x).sum(axis=1).max())
    tree = hn.fit(x[::4], top, 60)
    leaf = tree.leaf_of(x)
    shape = (len(tree.points), hn.WAYS, hn.WAYS)
    tree.low, tree.high = np.full(shape, np.inf), np.full(shape, -np.inf)
    for node, parts in enumerate(tree.under()):
        for c, leaves in enumerate(parts):
            d = tree.apart(x[np.isin(leaf, leaves)], tree.points[node])
            if len(d):
                tree.low[node, : d.shape[1], c], tree.high[node, : d.shape[1], c] = d.min(axis=0), d.max(axis=0)
    q = x[::40]
    scores = q @ x.T
    low, high = np.quantile(scores, 0.9, axis=1), np.quantile(scores, 0.95, axis=1)
    go = tree.reached(q, tree.from_anchors(q, high[:, None])[:, 0], tree.from_anchors(q, low[:, None])[:, 0])
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    assert all(go[a, leaf[b]] for a, b in zip(*np.nonzero(inside)))
    assert tree.leaves > 30 and go.mean() < 0.5


def test_odd_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, 1, [1.0]), (51, 1, [1.0])]) == []
    assert run(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert run(spark, [(50, 1, [1.0]), (51, 1, [1.0]), (52, 2, [0.9]), (53, 2, [0.5])]) == [(50, 51, 1, 52, 65536, 58880), (50, 51, 2, 53, 65536, 32768)]
