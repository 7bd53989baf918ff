import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import language_id as li
from tallyfield.llm import textarrays as ta


@pytest.mark.parametrize("segment", [1, 4, 1 << 21])
def test_bundle_is_the_sum_of_bound_trigrams(monkeypatch, segment):
    texts = ["Ab, cé!", "", "x", "ÀB cd"]
    monkeypatch.setattr(li, "SEGMENT", segment)
    got, total = li.bundles(*ta.flat(pa.array(texts)), np.arange(4), 4)
    assert total.tolist() == [4, 0, 1, 4]
    for i, text in enumerate(texts):
        want = np.zeros(li.DIM)
        s = "".join(c.lower() if c.isalpha() else "\0" for c in "\0" + text + "\0")
        for j in range(1, len(s) - 1):
            if s[j] != "\0":
                a, b, c = (li._vector(ord(x) if x != "\0" else 0) for x in s[j - 1 : j + 2])
                want += np.roll(a, 2) * np.roll(b, 1) * c
        assert np.array_equal(got[i], want)


def test_learns_only_from_the_other_folds_and_predicts_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 150 < len(held) < 250
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, "aaa bbb", "x"), (2, "ccc ddd", "y"), (3, None, "x"), (4, " 12 !", None), (5, "aab", None), (None, "ccd", None), (5, "aab", None)]
    df = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = li.train(df)
    got = sorted(((r.doc_id, r.lang_pred) for r in li.predict(df.drop("lang_pred", "score"), model, ["doc_id"]).collect()), key=str)
    assert got == sorted([(1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "x"), (5, "x"), (None, "y")], key=str)
    assert li.identify(df.limit(0)).count() == 0
    none = li.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def plain_bundle(text):
    out = np.zeros(li.DIM, dtype=np.int64)
    s = ["\0", *[c.lower() if c.isalpha() else "\0" for c in text], "\0"]
    for a, b, c in zip(s, s[1:], s[2:]):
        if b != "\0":
            a, b, c = (li._vector(0 if x == "\0" else ord(x)).astype(np.int64) for x in (a, b, c))
            out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_predictions_equal_brute_force(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text"), "lang").collect() if r.text and len(r.text) < 3000]
    assert len(rows) > 100
    bundle = {d: plain_bundle(t) for d, t, _ in rows}
    held = {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    names = sorted({lang for d, _, lang in rows if d not in held and lang})
    profile = {n: sum(bundle[d] for d, _, lang in rows if lang == n and d not in held) for n in names}
    got = {r.doc_id: r for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)).collect()}
    for d, t, _ in rows:
        cosines = [float(bundle[d] @ profile[n]) / max(1e-9, math.sqrt(float(bundle[d] @ bundle[d])) * math.sqrt(float(profile[n] @ profile[n]))) for n in names]
        best = int(np.argmax(cosines))
        has = any(c.isalpha() for c in t)
        assert (got[d].lang_pred, got[d].held_out) == (names[best] if has else "und", d in held)
        assert abs(got[d].score - (max(0, cosines[best]) if has else 0)) < 1e-9


def test_memory_is_bounded_for_many_letters():
    """4 MB of one text over 6,000 letters: nearly every trigram is another kind."""
    r = random.Random(2)
    data, offsets = ta.flat(pa.array(["".join(chr(0x4E00 + r.randrange(6000)) for _ in range(1_400_000))]))
    li._letters()
    tracemalloc.start()
    _, total = li.bundles(data, offsets, np.zeros(1, np.int64), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total[0] == 1_400_000 and peak < 600e6
