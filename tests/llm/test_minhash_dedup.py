import random
import re

import numpy as np
import pytest

from tallyfield.llm import minhash_dedup as m
from tallyfield.llm import textarrays as ta


def brute(rows, k, percent):
    """{doc_id: component} by all pairs."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, bases = [], [[r.choice(vocabulary) for _ in range(r.choice([3, 20, 60, 200]))] for _ in range(12)]
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w).upper() if r.random() < 0.2 else "\n".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \t\n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one two")]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 256), (5, 80, 7)])
def test_equals_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(m, "BLOCK", block)
    rows = corpus(k)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, rep int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x " * 50000)], "doc_id long, text string")
    got = sorted(m.near_duplicates(odd).collect(), key=str)
    assert [r.component_id for r in got if r.doc_id == 1] == [1, 1]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 1 << 62, (400, 280), dtype=np.uint64)
    pairs = np.concatenate([np.stack([y[:240], np.concatenate([y[:200], y[240:]])]) for y in x])
    sig = m.superminhash(pairs.reshape(-1), np.arange(801) * 240)
    assert abs((sig[::2] == sig[1::2]).mean() - 200 / 280) < 0.02
    small = m.superminhash(x[0, :3], np.array([0, 3, 3]))
    assert np.isfinite(small[0]).all() and np.isinf(small[1]).all()


def test_early_stop_changes_nothing():
    """The signature equals the plain algorithm's, run step by step for each shingle."""
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 900):
        v = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        want = np.full(m.PLACES, np.inf)
        p = np.tile(np.arange(m.PLACES), (n, 1))
        for j in range(m.PLACES):
            draw = ta.mixed(v + np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64)))
            r = (draw >> np.uint64(11)).astype(float) * 2.0**-53
            k = j + ((ta.mixed(draw ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)) * np.uint64(m.PLACES - j) >> np.uint64(32)).astype(int)
            for i in range(n):
                p[i, j], p[i, k[i]] = p[i, k[i]], p[i, j]
                want[p[i, j]] = min(want[p[i, j]], r[i] + j)
        assert np.array_equal(m.superminhash(v, np.array([0, n]))[0], want)
