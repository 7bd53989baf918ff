import math

import numpy as np
import pytest

from tallyfield.llm import embedding_dedup as ed


def brute(rows, threshold=0.93):
    good = {}
    for i, label, v in rows:
        x = None if v is None or not v or any(c is None for c in v) else np.array(v, dtype=float)
        if label is not None and x is not None and np.isfinite(x).all() and x.any():
            good[i] = (label, x / np.linalg.norm(x))
    ids = sorted(good)
    links = {i: set() for i, _, _ in rows}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if good[a][0] == good[b][0] and good[a][1] @ good[b][1] >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = {i: i for i in links}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in links:
        for b in links[a]:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(links[i]), find(i)) for i in links}


@pytest.mark.parametrize("block", [1024, 40])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    r = np.random.default_rng(8)
    base = r.standard_normal((60, 24))
    v = np.concatenate([base[r.integers(0, 60, 500)] + r.standard_normal((500, 24)) * r.choice([0, 0.1, 0.25, 0.4], (500, 1)), r.standard_normal((100, 24))])
    rows = [(i, int(r.integers(0, 2)), [float(x) for x in w * r.choice([1, 3.5])]) for i, w in enumerate(v)]
    rows += [(900, 1, None), (901, 1, [0.0] * 24), (902, None, rows[0][2]), (903, 1, [float("nan")] * 24), (904, 1, [1.0] * 23 + [None]), (905, 0, []), (906, 1, [float("inf")] * 24)]
    df = spark.createDataFrame([(*x, "s", 2) for x in rows], "vec_id long, label int, embedding array<double>, rep string, size int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in ed.near_vectors(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    true, ours = sum(n for n, _ in want.values()), sum(n for n, _ in got.values())
    assert true > 400 and all(got[i][0] <= want[i][0] for i in want)
    assert ours >= 0.995 * true, (ours, true)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_recall_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(x.vec_id, x.label, list(x.embedding)) for x in df.collect()]
    want = brute(rows)
    got = {x.vec_id: (x.n_links, x.component_id) for x in ed.near_vectors(df).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.998 * len(want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (4, 1, [2.0, 4.0])], "vec_id long, label int, embedding array<double>")
    assert ed.near_vectors(df.limit(0)).count() == 0
    got = sorted(((r.vec_id, r.component_id, r.kept) for r in ed.near_vectors(df).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (4, 1, False), (None, None, True)]


def links_of(label, u, threshold=0.93):
    """{id: n_links} by all products, for many vectors."""
    near = (u @ u.T >= threshold) & (label[:, None] == label[None, :])
    return near.sum(axis=1) - 1


def as_table(spark, label, u):
    return spark.createDataFrame([(i, int(x), v.tolist()) for i, (x, v) in enumerate(zip(label, u))], "vec_id long, label int, embedding array<double>")


@pytest.mark.parametrize("order", [0, 2, 3])
def test_dense_group(spark, monkeypatch, order):
    """A third of a label lies around one vector, most of its pairs close to the threshold on either side."""
    if order:  # crossings of two and three tails, which large labels get
        monkeypatch.setattr(ed, "plan", lambda n, threshold, window: (order, 1.0, ed.needed(2 * ed.meeting(1.0, threshold, window), order)))
    r = np.random.default_rng(3)
    one = r.standard_normal(64)
    n = 100 if order == 3 else 1000
    u = np.concatenate([one + r.standard_normal((n, 64)) * 0.27, r.standard_normal((2 * n, 64))])
    u /= np.linalg.norm(u, axis=1)[:, None]
    label = np.zeros(len(u), dtype=int)
    want = links_of(label, u)
    got = np.array([x.n_links for x in ed.near_vectors(as_table(spark, label, u)).orderBy("vec_id").collect()])
    assert 0.2 * n * n < want.sum() < 0.95 * n * n
    assert (got <= want).all() and got.sum() >= 0.9999 * want.sum(), (got.sum(), want.sum())


def test_small_labels_beside_a_large_one(spark):
    r = np.random.default_rng(4)
    label = np.concatenate([np.zeros(5000, dtype=int), *[np.full(n, k + 1) for k, n in enumerate((1, 2, 3, 10, 100))]])
    one = r.standard_normal((6, 64))
    u = np.where((label == 0)[:, None], r.standard_normal((len(label), 64)), one[label] + r.standard_normal((len(label), 64)) * 0.2)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = links_of(label, u)
    assert all(want[label == k].all() for k in (2, 3, 4, 5))
    got = np.array([x.n_links for x in ed.near_vectors(as_table(spark, label, u)).orderBy("vec_id").collect()])
    assert (got == want).all()


@pytest.mark.parametrize("cosine", [0.6, 0.9])
def test_labels_that_point_one_way(spark, cosine):
    """All vectors of a label lie around its mean, and near pairs around the mean itself."""
    r = np.random.default_rng(5)
    mean = r.standard_normal(64) / 8
    spread = math.sqrt((1 - cosine) / cosine)
    u = np.concatenate([mean + r.standard_normal((3000, 64)) / 8 * spread, mean + r.standard_normal((60, 64)) / 8 * 0.27])
    u /= np.linalg.norm(u, axis=1)[:, None]
    label = np.zeros(len(u), dtype=int)
    want = links_of(label, u)
    assert want[3000:].all() and abs((u[:500] @ u[500:1000].T).mean() - cosine) < 0.05
    got = np.array([x.n_links for x in ed.near_vectors(as_table(spark, label, u)).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.9999 * want.sum(), (got.sum(), want.sum())


def test_vectors_of_several_lengths(spark):
    rows = [(i, 1, [1.0, 2.0 + i / 100]) for i in range(5)] + [(9, 1, [1.0, 2.0, 3.0]), (10, 1, [1.0, 2.0, 3.01]), (11, 2, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in ed.near_vectors(df).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 9: (1, 9), 10: (1, 9), 11: (0, 11)}


def test_ids_with_several_vectors(spark):
    """Each vector of an id links by itself, and through the id all of them are one component, in every run."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v: [x + 0.05 for x in v]
    rows = [(1, 0, a), (1, 0, b), (2, 0, near(a)), (3, 0, near(b)), (4, 0, [0.0, 0.0, 1.0]), (5, 1, a), (4, 1, near(a)), (4, 1, near(a))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for n in (1, 3, 8):
        got = {(x.vec_id, x.n_links, x.component_id) for x in ed.near_vectors(df.repartition(n)).collect()}
        assert got == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 4), (5, 2, 4)}


def moved(spark, after=-1):
    """The last stage so far, and the bytes that the stages beyond ``after`` shuffled, spilled and wrote."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [stages.apply(k) for k in range(stages.size())]
    return max((x.stageId() for x in stages), default=-1), sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in stages if x.stageId() > after)


def test_what_is_moved_follows_the_input(spark):
    """Vectors are sent and written a few times at most, whatever the number of tails that they lie in."""
    n, dim = 6000, 64
    u = np.random.default_rng(11).standard_normal((n, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(u)], "vec_id long, label int, embedding array<float>")
    last, _ = moved(spark)
    assert ed.near_vectors(df).where("kept").count() == n
    assert 2 * n * dim * 4 < moved(spark, last)[1] < 6 * n * dim * 4


@pytest.mark.parametrize("block", [1 << 17, 200])
def test_near_copies_in_one_and_several_blocks(spark, monkeypatch, block):
    """Tight groups with exact copies, wider ones around them, and what lies between a group and the rest."""
    monkeypatch.setattr(ed, "BLOCK", block)
    r = np.random.default_rng(12)
    one = r.standard_normal((4, 64))
    v = one[r.integers(0, 4, 1200)] + r.standard_normal((1200, 64)) * r.choice([0.02, 0.1, 0.2, 0.28], (1200, 1))
    v = np.concatenate([v, v[:150], r.standard_normal((300, 64))]).astype(np.float32)
    label = np.arange(len(v)) // 5 % 2
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = brute([(i, int(x), y.tolist()) for i, (x, y) in enumerate(zip(label, v))])
    assert (links_of(label, u) == [want[i][0] for i in range(len(v))]).all() and sum(n for n, _ in want.values()) > 100_000
    df = spark.createDataFrame([(i, int(x), y.tolist()) for i, (x, y) in enumerate(zip(label, v))], "vec_id long, label int, embedding array<float>")
    assert {x.vec_id: (x.n_links, x.component_id) for x in ed.near_vectors(df).collect()} == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_tails_of_several_slabs(monkeypatch, order):
    """Pairs are linked once, wherever their collisions are."""
    monkeypatch.setattr(ed, "SLAB", 16)
    r = np.random.default_rng(13)
    u = np.concatenate([r.standard_normal(64) + r.standard_normal((300, 64)) * 0.27, r.standard_normal((300, 64))])
    u = u[r.permutation(600)] / 8
    u /= np.linalg.norm(u, axis=1)[:, None]
    window = ed.WIDTH * math.sqrt(2 * 0.07)
    planned = (order, 1.0, ed.needed(2 * ed.meeting(1.0, 0.93, window), order))
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    for own in (None, 250):
        if own:
            near[:own, :own] = near[own:, own:] = False
        assert (ed._compare(u, np.ones(600, dtype=np.int64), own, planned, 0.93, window).links == near.sum(axis=1)).all()
