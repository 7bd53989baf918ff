import re

import duckdb

import corpus_pipeline as cp
from tallyfield.llm import sentencepiece_codec as sc
from tallyfield.session import stored
from tests.llm.test_minhash_dedup import brute as groups
from tests.llm.test_substring_dedup import brute as spans

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = [(5000, None, "en", "s", 0), (5001, " 12 3!", "en", "s", 6), (5002, "", "en", "s", 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    items = [(i, re.sub(r"[\W_]+", " ", t.lower()).split()) for i, t in duckdb.connect().execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES:
        if name == "language_id":
            rows = {d: t for d, t in rows.items() if t and any(c.isalpha() for c in t)}
        elif name == "near_dedup":
            rows = {d: rows[d] for d, (_, c) in groups(list(rows.items()), 5, 80).items() if c == d}
        elif name == "substring_dedup":
            out = stored(stage(spark, docs, SF), "test")
            rows = check_repeats(rows, {r.doc_id: r.text for r in out.collect()})
        elif name == "decontamination":
            grams = {d: {tuple(x[i : i + 5]) for i in range(len(x) - 4)} for d in rows if (x := re.sub(r"[\W_]+", " ", " ".join(rows[d])).split())}
            held = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in items]
            rows = {d: t for d, t in rows.items() if not any(len(h & grams[d]) * 100 >= 80 * len(h) for h in held)}
        out = stored(stage(spark, docs, SF), "test")
        if name == "sentencepiece":
            codec = sc.Codec(sc.piece_bpe())
            texts = {r.doc_id: r.text for r in docs.collect()}
            got = {r.doc_id: r.ids for r in out.collect()}
            assert set(got) == set(rows) and all(codec.decode(ids) == texts[d] for d, ids in got.items())
            break
        assert out.columns == columns, name
        got = {r.doc_id: r.text for r in out.collect()}
        assert set(got) == set(rows), name
        docs = out


def windows(words, size):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def check_repeats(before, after):
    """Words of each document that stays, after checking that repeated passages and nothing else went."""
    left = spans(list(before.items()), 3, 10)
    words = {d: (t or "").lower().split() for d, t in before.items()}
    kept = {d: (t or "").lower().split() for d, t in after.items()}
    short, long, caught = set(), set(), 0
    for d in sorted(before):
        own_short, own_long = windows(words[d], 32), windows(words[d], 51)
        again = len(words[d]) - 31 > len(own_short)  # it repeats itself
        if not own_short & short and not left[d][1] and not again:
            assert after[d] == before[d], d
        rest = iter([w for s in left[d][2] for w in s])
        assert all(w in rest for w in kept.get(d, [])), d  # the rule of three sentences, and in order
        text = f" {' '.join(kept.get(d, []))} "
        caught += bool(own_long & long)
        assert not any(f" {' '.join(w)} " in text for w in own_long & long), d
        if d not in after:
            assert words[d] and (own_short & short or left[d][1]), d
        short |= own_short
        long |= own_long
    assert caught > 5
    return {d: kept[d] for d in after}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stored(stage(spark, docs, SF), "empty")
        assert out.count() == 0
        docs = out
