import json
import random

from tallyfield.operators import expectations as ex


def tree(r, depth):
    kind = r.choice(["compound", "any_of", "negation"] if depth else [*ex.LEAVES])
    if depth and r.random() < 0.3:
        kind = r.choice([*ex.LEAVES])
    subject = lambda: r.choice("abcz")
    if kind in ex.INNER:
        return {"type": kind, "sub_expectations": [tree(r, depth - 1) for _ in range(1 if kind == "negation" else r.randint(1, 3))]}
    return {"type": kind, "winner": subject(), "loser": subject(), "min_gap": r.choice([-2, 0, 1]), "subject": subject(), "metric": "m", "max_score": r.choice([1, 2.5]), "duration_threshold_seconds": r.choice([100, 1000])}


def value(t, scores, duration):
    kind = t["type"]
    if kind == "disputed_manual_review":
        return None
    if kind == "insufficient_evidence":
        return None if duration is None else duration < t["duration_threshold_seconds"]
    if kind == "pairwise_minimum_gap":
        return None if t["winner"] not in scores or t["loser"] not in scores else scores[t["winner"]] - scores[t["loser"]] >= t["min_gap"]
    if kind == "must_not_exceed":
        return None if t["subject"] not in scores else scores[t["subject"]] <= t["max_score"]
    if kind == "must_not_rank_first_solely_on_metric":
        return None if t["subject"] not in scores else min(scores, key=lambda s: (-scores[s], s)) != t["subject"]
    parts = [value(x, scores, duration) for x in t["sub_expectations"]]
    if kind == "negation":
        return None if parts[0] is None else not parts[0]
    end = kind == "any_of"
    return end if end in parts else None if None in parts else not end


def leaves(t):
    return [x for s in t["sub_expectations"] for x in leaves(s)] if t["type"] in ex.INNER else [t]


def test_trees_equal_recursion(spark):
    r = random.Random(7)
    trees = [tree(r, r.randint(0, 4)) for _ in range(300)]
    scores = {g: {s: float(r.randint(0, 4)) for s in "abc" if r.random() < 0.8} for g in range(20)}
    durations = {g: r.choice([50, 500]) for g in range(15)}
    cases = spark.createDataFrame([(i, i % 20, json.dumps(t)) for i, t in enumerate(trees)], "case_id int, game_id int, expectation string")
    rows = spark.createDataFrame([(g, s, v) for g, x in scores.items() for s, v in x.items()], "game_id int, subject string, score double")
    got = ex.evaluate(cases, rows, spark.createDataFrame([*durations.items()], "game_id int, duration int")).collect()
    assert len(got) == 300
    for x in got:
        t, g = trees[x.case_id], x.case_id % 20
        parts = [value(y, scores[g], durations.get(g)) for y in leaves(t)]
        assert (x.passed, x.parts, x.resolved) == (value(t, scores[g], durations.get(g)), len(parts), sum(p is not None for p in parts))


def test_unfit_nodes(spark):
    texts = {
        "unknown_type": ["no", "[]", "{}", '{"type": "luck"}', None], "no_parts": ['{"type": "any_of"}', '{"type": "compound", "sub_expectations": []}'], "missing_winner": ['{"type": "pairwise_minimum_gap", "loser": "a", "min_gap": 1}'],
        "max_score_not_numeric": ['{"type": "must_not_exceed", "subject": "a", "max_score": true}', '{"type": "must_not_exceed", "subject": "a", "max_score": "1"}'], "missing_duration_threshold_seconds": ['{"type": "insufficient_evidence"}'],
        None: ['{"type": "must_not_exceed", "subject": "a", "max_score": 1}', '{"type": "must_not_exceed", "subject": "a", "max_score": 1e3}', '{"type": "disputed_manual_review"}', '{"type": "negation", "sub_expectations": [{"type": "disputed_manual_review"}]}'],
    }
    flat = [(i, 1, t, reason) for i, (reason, t) in enumerate((r, t) for r, ts in texts.items() for t in ts)]
    cases = spark.createDataFrame([x[:3] for x in flat], "case_id int, game_id int, expectation string")
    found = {r.case_id: r.p for r in ex.nodes(cases).where("path = '00000'").select("case_id", ex.node_problem().alias("p")).collect()}
    assert found == {i: reason for i, _, _, reason in flat}
