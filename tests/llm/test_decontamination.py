import random
import re

from tallyfield.llm import decontamination as dc


def brute(docs, items, k=5, percent=80):
    def grams(t):
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    out, held = set(), [(i, grams(t)) for i, t in items if i is not None]
    for d, t in docs:
        g = grams(t)
        out |= {(d, i, len(h), len(h & g)) for i, h in held if d is not None and h and len(h & g) * 100 >= percent * len(h)}
    return out


def test_equals_brute_force_at_every_size(spark):
    r = random.Random(6)
    word = lambda: r.choice("ab bc cd de ef fg gh hi ij jk kl lm mn".split())
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 5, 6, 12, 40, 130])))) for i in range(40)] + [(90, None), (91, "..."), (None, "a b c d e f")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(r.choice([0, 4, 30, 400]))]
        if r.random() < 0.6:
            part = r.choice(items)[1] or ""
            part = part.split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if part:
                    part[r.randrange(len(part))] = "zz"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + r.choice(["", ",", "!"]) for x in part]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, " ?! "), (None, items[5][1]), (503, "pad " * 30000 + items[5][1])]
    df = spark.createDataFrame([(*x, 1, "h") for x in docs], "doc_id long, text string, n_shared int, h string")
    it = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, s string")
    got = [(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in dc.contained_items(df, it).collect()]
    want = brute(docs, items)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 25
    left = dc.drop_contaminated(df, it)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "x")], "doc_id long, text string")
    it = spark.createDataFrame([(7, "A, b. c d e f")], "item_id long, text string")
    assert [tuple(r) for r in dc.contained_items(df, it).collect()] == [(1, 7, 2, 2)]
    assert dc.contained_items(df.limit(0), it).count() == 0
    assert dc.contained_items(df, it.limit(0)).count() == 0
    assert dc.drop_contaminated(df, it.limit(0)).count() == 3


def test_main_path_is_native(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    it = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = dc.contained_items(df, it)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
