import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import lm_scoring as lm
from tallyfield.llm.eliasfano import BigramTrie, EliasFano


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1 << 40), (1000, 1200), (5000, 1 << 30)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, top, n, dtype=np.uint64))
    ef = EliasFano.build(values)
    assert np.array_equal(ef.get(np.arange(n)), values)
    asked = np.concatenate([values[::7], r.integers(0, top + 9, 200, dtype=np.uint64)])
    found = ef.find(asked)
    assert all((values[p] == x) if p >= 0 else x not in values for p, x in zip(found, asked))


def test_trie():
    r = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in zip(r.zipf(1.2, 4000) % 900, r.zipf(1.2, 4000) % 5000)})
    v, w = (np.array(x, dtype=np.uint64) for x in zip(*pairs))
    contexts, counts = np.unique(v, return_counts=True)
    code, backoff = r.integers(1, 256, len(v)).astype(np.uint8), r.integers(1, 256, len(contexts)).astype(np.uint8)
    trie = BigramTrie(BigramTrie.pack(contexts, counts, w, backoff, code))
    got, back = trie.query(v, w)
    assert np.array_equal(got, code) and np.array_equal(back, np.repeat(backoff, counts))
    asked = np.stack([r.integers(0, 1000, 5000), r.integers(0, 5100, 5000)]).astype(np.uint64)
    want = {p: c for p, c in zip(pairs, code)}
    assert [want.get((int(a), int(b)), 0) for a, b in asked.T] == trie.query(*asked)[0].tolist()


def brute(rows):
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for d, t, _ in rows}
    one, two, ctx, kept = Counter(), Counter(), Counter(), Counter()
    for d, _, held in rows:
        if not held:
            one.update(tokens[d])
            two.update(zip([None, *tokens[d]], tokens[d]))
    for (a, _), c in two.items():
        ctx[a] += c
    n, v, out = sum(one.values()), len(one), {}
    code = lambda x: lm.CODES[lm.coded(np.array([x]))[0]]
    for (a, _), c in two.items():
        kept[a] += code((c - lm.DISCOUNT) / ctx[a])
    assert all(kept[a] + code(1 - kept[a]) <= 1 + 1e-9 for a in ctx)  # what a context's probabilities sum to at most
    for d, _, held in rows:
        base = score = 0.0
        for a, b in zip([None, *tokens[d]], tokens[d]):
            p1 = (one[b] + 1) / (n + v + 1)
            base += math.log10(p1)
            p = code((two[a, b] - lm.DISCOUNT) / ctx[a]) if two[a, b] else 0.0
            score += math.log10(p + (code(1 - kept[a]) if ctx[a] else 1.0) * p1)
        out[d] = (bool(held), len(tokens[d]), sum(one[x] > 0 for x in tokens[d]), n, round(base, 6), round(score, 6))
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TEXT", 60_000)
    rows = [(r.doc_id, r.text, r.held) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "doc_id % 7 = 2 held").collect()]
    rows += [(1000, None, False), (1001, "", True), (1002, "THE the  \n Of", None), (1003, "é x " * 9000, False)]
    df = spark.createDataFrame([(*r, 1, "v") for r in rows], "doc_id long, text string, held boolean, n int, v string").repartition(5)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(df, F.col("held")).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for d, x in want.items():
        assert got[d] == pytest.approx(x[1:], abs=2e-5), d


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert lm.score(df.limit(0), F.lit(False)).count() == 0
    got = lm.score(df, F.lit(False)).collect()
    assert sorted((str(r.doc_id), r.train_tokens) for r in got) == [("3", 9), ("3", 9), ("None", 9)]
    assert {(r.base_score, r.score) for r in lm.score(df, F.lit(True)).collect()} == {(0.0, 0.0)}
