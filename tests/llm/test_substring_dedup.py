import random
import re

from pyspark.sql import functions as F

from tallyfield.llm import substring_dedup as sd


def brute(rows, span, min_words):
    split = {}
    for d, t in rows:
        parts, at = [], 0
        for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", t or ""):
            gap = (t or "")[at : m.start()]
            if not parts or "\n" in gap or parts[-1][-1][-1] in ".!?":
                parts.append([])
            parts[-1].append(m[0].lower())
            at = m.end()
        split[d] = [tuple(p) for p in parts]
    seen, gone = set(), {d: set() for d in split}
    for d in sorted(split):
        s = split[d]
        for i in range(len(s) - span + 1):
            run = tuple(s[i : i + span])
            if sum(map(len, run)) >= min_words:
                if run in seen:
                    gone[d] |= set(range(i, i + span))
                seen.add(run)
    return {d: (len(split[d]), len(gone[d]), [x for i, x in enumerate(split[d]) if i not in gone[d]]) for d in split}


def test_equals_brute_force(spark):
    r = random.Random(5)
    line = lambda: " ".join(r.choice("ab bc cd de ef fg gh".split()) for _ in range(r.randint(1, 6))) + r.choice([".", "!", "?", "\n", ". "])
    passages = [[line() for _ in range(r.randint(3, 8))] for _ in range(6)]
    rows = []
    for d in range(80):
        parts = [line() for _ in range(r.randint(0, 10))]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            i = r.randint(0, len(parts))
            parts[i:i] = p
        rows.append((d, " ".join(parts)))
    rows += [(80, None), (81, ""), (82, " \n"), (83, "é. " * 3000)]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n_removed int, place string").repartition(7)
    want = brute(rows, 3, 10)
    got = sd.remove_repeats(df, 3, 10).collect()
    assert len(got) == len(rows)
    for x in got:
        n, removed, left = want[x.doc_id]
        assert (x.n_sentences, x.n_removed) == (n, removed), x
        again = brute([(0, x.text)], 3, 10)[0]
        assert [w for s in left for w in s] == (x.text or "").lower().split()
        assert again[0] <= n
    assert {x.doc_id: x.text for x in got}[80] is None


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d. e f g h. i j k l."), (1, "a b c d. e f g h. i j k l."), (1, "a b c d. e f g h. i j k l."), (2, "x. a b c d.  E f g h. i j k l. y")], "doc_id long, text string")
    got = {(r.doc_id, r.text, r.n_removed) for r in sd.remove_repeats(df).collect()}
    assert got == {(None, "a b c d. e f g h. i j k l.", 0), (1, "a b c d. e f g h. i j k l.", 0), (2, "x. y", 3)}
    assert sd.remove_repeats(df.where(F.lit(False))).count() == 0


def repeated_windows(texts):
    seen, n = {}, 0
    for d, text in texts:
        w = (text or "").lower().split()
        for i in range(len(w) - 50):
            n += seen.setdefault(tuple(w[i : i + 51]), d) != d
    return n


def test_passages_of_over_50_words_go(spark):
    """What stays lies between edits of near copies, with fewer than three whole sentences."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = repeated_windows((r.doc_id, r.text) for r in docs.orderBy("doc_id").collect())
    after = repeated_windows((r.doc_id, r.text) for r in sd.remove_repeats(docs).orderBy("doc_id").collect())
    assert before > 1000 and after < 0.05 * before, (before, after)


def words_of(r, n):
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def test_long_passages_with_few_whole_sentences(spark):
    """Passages of 60 words: two whole sentences, one sentence, and parts of sentences on either side."""
    r = random.Random(6)
    two, one, parts = words_of(r, 60), words_of(r, 60), words_of(r, 60)
    two[29] += "."
    two[59] += "."
    one[59] += "."
    parts[25] += "."
    rows = []
    for d in range(2):
        own = [" ".join(words_of(r, 20)) for _ in range(4)]
        rows += [(3 * d, f"{own[0]}. {' '.join(two)} {own[1]}."), (3 * d + 1, f"{own[2]}. {' '.join(one)} {own[3]}."), (3 * d + 2, f"{own[0]} {' '.join(parts)} {own[1]}.")]
    rows[5] = (5, f"{' '.join(words_of(r, 20))} {' '.join(parts)} {' '.join(words_of(r, 20))}.")
    got = {x.doc_id: x for x in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d].n_removed for d in range(6)] == [0, 0, 0, 2, 1, 2]
    assert [got[d].text for d in range(3)] == [t for _, t in rows[:3]]
    for d, passage in ((3, two), (4, one)):
        assert not set(passage) & set(got[d].text.split()) - set(rows[d][1].split()[:20]) - set(rows[d][1].split()[-20:])
    left, whole = got[5].text.split(), rows[5][1].split()
    assert left[:20] == whole[:20] and left[-20:] == whole[-20:]
    assert len(left) <= 40 + 2 * (sd.PASSAGE - sd.ANCHOR)
    assert repeated_windows([(d, got[d].text) for d in sorted(got)]) == 0


def test_every_repeated_window_is_touched(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    seen, texts = {}, {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    for d in sorted(texts):
        w = texts[d].lower().split()
        new = [tuple(w[i : i + 51]) for i in range(len(w) - 50)]
        assert not any(x in seen for x in new) or got[d].n_removed > 0, d
        seen.update(dict.fromkeys(new, d))
    assert sum(r.n_removed > 0 for r in got.values()) > 100
