import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfield.operators import composite, corpus, draft, evaluation, history, models, shapes
from tallyfield.operators import timeline as tl
from tallyfield.operators.components import connected_components


def players(spark, rows=10, **change):
    base = dict(kills=2, deaths=2, assists=2, gold_earned=9000, cs=100, damage_to_champions=500, damage_to_objectives=50, damage_to_turrets=20, vision_score=10, wards_placed=3, wards_killed=1, damage_mitigated=70, healing=10)
    out = []
    for i in range(rows):
        row = dict(game_id=1, participant_id=i + 1, team_id=100 if i < 5 else 200, role=("top", "jungle", "mid", "bot", "support")[i % 5], win=i < 5, duration=1800) | base
        out.append(row | change.get(f"p{i + 1}", {}))
    return spark.createDataFrame(out)


def test_equal_players_get_middle_percentiles(spark):
    got = composite.score_composite(players(spark)).orderBy("match_rank").collect()
    assert {round(r.combat, 9) for r in got} == {50.0}
    assert [r.participant_id for r in got] == list(range(1, 11))  # the winners, then ids
    assert {round(r.total_score, 6) for r in got} == {54.0, 50.0}


def test_nine_players_are_rejected_and_strong_losers_win(spark):
    assert composite.score_composite(players(spark, 9)).count() == 0
    strong = dict(kills=15, assists=9, damage_to_champions=9000, gold_earned=20000, damage_to_objectives=900, vision_score=50)
    got = composite.score_composite(players(spark, p8=strong)).where("match_rank = 1").collect()
    assert got[0].participant_id == 8


def test_observations(spark):
    got = {r.participant_id: r.observations for r in composite.observations(composite.score_composite(players(spark, p2=dict(kills=9, vision_score=40)))).collect()}
    assert "Highest vision score in the match." in got[2] and "Highest kill participation on the team." in got[2]
    assert all(1 <= len(x) <= 4 for x in got.values())


def test_midrank(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 2, 3, 5)], "g int, v int")
    assert sorted(r[0] for r in df.select(composite.midrank("v", ["g"])).collect()) == [0, 37.5, 37.5, 75, 100]


def test_interval_join_equals_nested_loop(spark):
    r = random.Random(1)
    rows = [(r.randint(0, 2), i, r.randint(0, 90000)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, id int, t_ms long")
    got = {(x.l.id, x.r.id) for x in tl.interval_join(df, df, ["g"], 700, 1500).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] - 700 <= b[2] <= a[2] + 1500}


def test_asof(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 100, "b"), (2, 10, "c")], "k int, t long, n string")
    right = spark.createDataFrame([(1, 5, 50), (1, 10, 51), (1, 60, None), (1, 20, 52)], "k int, t long, v int")
    assert {r.n: r.asof for r in tl.asof_join(left, right, ["k"], "t", "v", 60).collect()} == {"a": 51, "b": None, "c": None}


def test_trade_states(spark):
    e = [(1, 1, 1000, "champion_kill", 6, 1, None, 0, 0), (1, 2, 5000, "champion_kill", 2, 6, None, 10, 10), (1, 3, 50000, "champion_kill", 7, 3, None, 0, 0), (1, 4, 90000, "champion_kill", 8, 4, None, 0, 0), (1, 5, 95000, "champion_kill", 5, 9, None, None, None)]
    df = spark.createDataFrame(e, "game_id int, event_id int, t_ms long, kind string, killer int, victim int, assist int, x int, y int")
    got = {r.event_id: r.trade for r in tl.trades(df).collect()}
    assert (got[1], got[3], got[4]) == ("traded", "untraded", "unknown")


def test_components_equal_union_find(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1400)] + [(7000, 7000), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_splits_keep_players_together(spark):
    e = spark.createDataFrame([(g, p) for g in range(60) for p in (g // 3, 100 + g)], "game_id long, puuid long")
    s = corpus.assign_splits(e, "game_id", "puuid")
    assert s.count() == 60
    assert corpus.check_leakage(e.join(s, "game_id"), "puuid").count() == 0


def test_lookback_sees_the_past_only(spark):
    rows = [("a", "top", f"2024-01-0{d} 00:00:00", d, float(d)) for d in (1, 2, 3, 3, 4)]
    df = spark.createDataFrame(rows, "puuid string, role string, creation string, game_id int, total_score double").withColumn("creation", F.col("creation").cast("timestamp"))
    got = sorted((r.game_id, r.previous) for r in history.lookback(df, 2).collect())
    assert got == [(1, []), (2, [1.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (4, [3.0, 3.0])]


def test_activation_never_downgrades(spark):
    runs = spark.createDataFrame([(1, "aggregate", 9, 5, 1), (1, "match_v5", 1, 1, 2), (1, "match_v5", 1, 3, 3), (2, "what", 1, 1, 4)], "game_id int, tier string, model_version int, created_at int, run_id int")
    assert {r.game_id: r.run_id for r in history.active_runs(runs).collect()} == {1: 3, 2: 4}


def test_roles_best_permutation(spark):
    w = [[0.0, 9.0, 1.0, 1.0, 1.0], [9.0, 8.0, 1.0, 1.0, 1.0], [1.0, 1.0, 5.0, 5.0, 1.0], [1.0, 1.0, 5.0, 4.0, 1.0], [1.0, 1.0, 1.0, 1.0, 7.0]]
    got = draft.assign_roles(spark.createDataFrame([(1, w)], "team int, weights array<array<double>>")).collect()[0]
    assert got.roles == ["jungle", "top", "bot", "mid", "support"] and got.weight == 35.0


def test_linear_fit_recovers_signs_and_order(spark):
    r = random.Random(3)
    items = [(f"i{k}", r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)) for k in range(120)]
    truth = {x[0]: 2 * x[1] - x[2] for x in items}
    pairs = [(a[0], b[0], "left" if truth[a[0]] > truth[b[0]] else "right", 1.0) for a, b in zip(items, items[1:] + items[:1])]
    rec = spark.createDataFrame(items, "item_ref string, a double, b double, c double")
    d = models.pair_differences(spark.createDataFrame(pairs, "left_ref string, right_ref string, choice string, confidence double"), rec, ["a", "b", "c"])
    fit = models.fit_pairwise_linear(d, {"a": 1, "b": -1, "c": 1}, rate=1.0, iterations=25)
    c = fit.coefficients
    assert fit.pairs == 120 and c["a"] > -c["b"] > abs(c["c"]) and c["b"] < 0 <= c["c"]
    scored = rec.withColumn("s", models.linear_score(c))
    agree = {x.item_ref: x.s for x in scored.collect()}
    assert sum((agree[a] > agree[b]) == (k == "left") for a, b, k, _ in pairs) > 108


def test_isotonic():
    r = random.Random(4)
    assert shapes.isotonic([3.0, 1.0, 2.0]) == [2.0, 2.0, 2.0] and shapes.isotonic([1.0, 2.0], direction=-1) == [1.5, 1.5]
    for _ in range(50):
        v = [r.random() for _ in range(6)]
        w = shapes.isotonic(v)
        assert w == sorted(w) and abs(sum(w) - sum(v)) < 1e-9


def test_shapes_learn_a_step(spark):
    """Utility jumps at 7: stumps and splines must find it, and stay monotone."""
    r = random.Random(5)
    items = [(f"i{k}", float(r.randint(0, 14))) for k in range(150)]
    worth = {i: (10 if x >= 7 else 0) + 0.1 * x for i, x in items}
    pairs = [(a, b, "left" if worth[a] > worth[b] else "right" if worth[a] < worth[b] else "tie") for (a, _), (b, _) in zip(items, items[1:] + items[:1])]
    rec, df = spark.createDataFrame(items, "item_ref string, kills double"), spark.createDataFrame(pairs, "left_ref string, right_ref string, choice string")
    stumps = shapes.fit_boosted_stumps(df, rec, {"kills": 1}, rounds=3)
    assert stumps and all(s.low <= s.high for s in stumps) and 5 < stumps[0].threshold < 9
    curve = shapes.fit_pairwise_gam(df, rec, {"kills": 1}, iterations=15)["kills"]
    ys = [y for _, y in curve]
    assert ys == sorted(ys) and ys[-1] > ys[0] and len(curve) == 5
    one = rec.select(*[w.alias(f"w{i}") for i, w in enumerate(shapes.hats(F.col("kills"), [x for x, _ in curve]))]).collect()
    assert all(abs(sum(x) - 1) < 1e-9 for x in one)


def test_spline_and_stumps(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 3.0)] + [(None,)], "x double")
    assert [r[0] for r in df.select(models.spline_score({"x": [(0.0, 0.0), (1.0, 10.0), (2.0, 12.0)]})).collect()] == [0.0, 0.0, 5.0, 10.0, 12.0, 0.0]
    assert [r[0] for r in df.select(models.stump_score([("x", 0.5, -1.0, 2.0)])).collect()] == [-1.0, -1.0, 2.0, 2.0, 2.0, 0.0]


def test_zero_variance_and_bootstrap(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0), (2, 1.0, 1.0)], "g int, x double, y double")
    assert {r.g: r.pearson for r in evaluation.pearson(df, "x", "y", "g").collect()} == {1: None, 2: None}
    rows = spark.createDataFrame([(i % 40, i % 3 == 0) for i in range(2000)], "c int, hit boolean")
    b = evaluation.cluster_bootstrap(rows, "c", F.col("hit")).first()
    assert b.draws == 200 and abs(b["mean"] - 1 / 3) < 0.02 and b.low <= b["mean"] <= b.high


@pytest.mark.parametrize("name", ["m1_score_composite", "a7_fight_influence", "j5_k1_history_page", "j14_j16_resource_conversion", "a24_kendall_tau_b", "m25_infer_roles", "w13_next_step", "p40_build_records", "m29_p34_partners", "m22_shadow_status", "j7_run_list", "k5_stratified_sample", "p26_leaked_keys", "m31_legacy_backfill"])
def test_plans_stay_native(spark, name):
    from tallyfield.catalog import QUERIES
    import tallyfield.plans  # noqa: F401

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "NestedLoop")), name
    assert math.isfinite(len(plan))


def test_temporal_split_keeps_components_whole_and_in_order(spark):
    from tallyfield.operators.review import temporal_split

    e = spark.createDataFrame([(g, g // 2, f"2024-0{1 + g // 8}-0{1 + g % 8} 00:00:00") for g in range(40)], "game_id long, puuid long, at string").withColumn("at", F.col("at").cast("timestamp"))
    s = temporal_split(e, "game_id", "puuid", "at")
    rows = s.join(e, "game_id").collect()
    assert len(rows) == 40 and all(len({r.split for r in rows if r.component == c}) == 1 for c in {r.component for r in rows})
    last = {k: max(r.game_id for r in rows if r.split == k) for k in ("train", "validation", "test")}
    assert last["train"] < last["validation"] < last["test"] and sum(r.split == "train" for r in rows) == 32


def test_registered_fits_run_to_their_tolerances(spark, monkeypatch):
    """The linear and spline queries equal a plain fit that runs until its gradient vanishes, on the driver and the cluster."""
    import numpy as np

    from tallyfield.plans import models as plans

    p, pairs, names = plans._training(spark, "/root/testdata/sf0.001")
    diffs = models.pair_differences(pairs, models.normalize(p, list(names)), list(names))
    kept = {}
    linear, gam = models.fit_pairwise_linear, shapes.fit_pairwise_gam
    monkeypatch.setattr(models, "fit_pairwise_linear", lambda *a, **k: kept.setdefault("linear", linear(*a, **k)))
    monkeypatch.setattr(shapes, "fit_pairwise_gam", lambda *a, **k: kept.setdefault("gam", gam(*a, **k)))
    plans.m14_m18_fit_pairwise_linear(spark, "/root/testdata/sf0.001")
    plans.m15_fit_pairwise_gam(spark, "/root/testdata/sf0.001")
    rows = diffs.toPandas()
    x, y, w = rows[list(names)].to_numpy(), rows["target"].to_numpy(), rows["weight"].to_numpy()
    c, sign = np.zeros(len(names)), np.array(list(names.values()))
    for _ in range(20_000):
        c -= 0.05 * (((1 / (1 + np.exp(-x @ c)) - y) * w) @ x / len(x) + 0.05 * c)
        c = np.where(c * sign > 0, c, 0.0)
    assert kept["linear"].converged
    assert np.allclose([kept["linear"].coefficients[f] for f in names], c, atol=0.02)
    more = gam(pairs, p, names, l2=0.05, rate=0.05, iterations=40_000, tolerance=1e-13)
    assert all(abs(a[1] - b[1]) < 0.03 for f in names for a, b in zip(kept["gam"][f], more[f]))
    here = models.logistic_sums(diffs, list(names))(kept["linear"].coefficients)
    monkeypatch.setattr(models, "LOCAL", 0)
    assert np.allclose(here, models.logistic_sums(diffs, list(names))(kept["linear"].coefficients))


def plain_stumps(items, pairs, directions, rounds, min_leaf):
    """Rounds over all items, without bins or groups: [(feature, threshold, low, high)]."""
    score, out, before = dict.fromkeys(items, 0.0), [], None
    for _ in range(rounds):
        pull, loss = dict.fromkeys(items, 0.0), 0.0
        for a, b, choice in pairs:
            p, t, w = 1 / (1 + math.exp(score[b] - score[a])), {"left": 1.0, "right": 0.0, "tie": 0.5}[choice], 0.5 if choice == "tie" else 1.0
            loss -= w * (t * math.log(p) + (1 - t) * math.log(1 - p)) / len(pairs)
            pull[a] -= (p - t) * w
            pull[b] += (p - t) * w
        best = None
        for f, d in directions.items():
            values = sorted({v[f] for v in items.values() if v[f] is not None})
            for cut in [(x + y) / 2 for x, y in zip(values, values[1:])]:
                low, high = ([pull[i] for i, v in items.items() if v[f] is not None and (v[f] <= cut) == side] for side in (True, False))
                if min(len(low), len(high)) < min_leaf:
                    continue
                a, b = shapes.isotonic([sum(low) / len(low), sum(high) / len(high)], [1.0, 1.0], d)
                gain = sum(x * x for x in low + high) - sum((x - a) ** 2 for x in low) - sum((x - b) ** 2 for x in high)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, cut, a, b)
        if best is None or best[0] <= 1e-9:
            break
        _, f, cut, a, b = best
        out.append((f, cut, a * shapes.SHRINKAGE, b * shapes.SHRINKAGE))
        for i, v in items.items():
            score[i] += 0.0 if v[f] is None else out[-1][2] if v[f] <= cut else out[-1][3]
        if before is not None and abs(before - loss) < 1e-7:
            break
        before = loss
    return out


def plain_tree(items, pull, directions, depth, min_leaf, low, high):
    n = len(items)
    clip = lambda x, a, b: max(a, min(b, x))
    value = clip(sum(pull[i] for i in items) / n, low, high)
    best = None
    for f, d in directions.items() if depth and n >= 2 * min_leaf else ():
        values = sorted({v[f] for v in items.values() if v[f] is not None})
        for cut in [(x + y) / 2 for x, y in zip(values, values[1:])]:
            below, above = ({i: v for i, v in items.items() if v[f] is not None and (v[f] <= cut) == side} for side in (True, False))
            if min(len(below), len(above)) < min_leaf:
                continue
            a, b = (sum(pull[i] for i in x) / len(x) for x in (below, above))
            mid = clip((a + b) / 2, low, high)
            sides = [(low, mid), (mid, high)][:: 1 if d > 0 else -1] if d else [(low, high)] * 2
            a, b = clip(a, *sides[0]), clip(b, *sides[1])
            gain = sum((pull[i] - value) ** 2 for i in items) - sum((pull[i] - a) ** 2 for i in below) - sum((pull[i] - b) ** 2 for i in above)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, cut, below, above, sides)
    if best is None or best[0] <= 1e-9:
        return value
    _, f, cut, below, above, sides = best
    return (f, cut, plain_tree(below, pull, directions, depth - 1, min_leaf, *sides[0]), plain_tree(above, pull, directions, depth - 1, min_leaf, *sides[1]))


def walk(tree, v):
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        if v[f] is None:
            return 0.0
        tree = low if v[f] <= cut else high
    return tree


def noisy_pairs(spark):
    import random

    r = random.Random(4)
    items = {f"i{k}": {"x": r.choice([None, *[round(r.gauss(0, 1), 2) for _ in range(9)]]), "y": float(r.randint(0, 12)), "z": r.random()} for k in range(150)}
    names, pairs = sorted(items), []
    for _ in range(400):
        a, b = r.sample(names, 2)
        gap = (items[a]["y"] > 6) * 2 - (items[b]["y"] > 6) * 2 - (items[a]["x"] or 0) + (items[b]["x"] or 0) + r.gauss(0, 0.7)
        pairs.append((a, b, "tie" if abs(gap) < 0.2 else "left" if gap > 0 else "right"))
    records = spark.createDataFrame([(i, int(i[1:]) % 40, *v.values()) for i, v in items.items()], "item_ref string, game_id long, x double, y double, z double")
    return items, pairs, records, spark.createDataFrame([*pairs, ("i1", "none", "left"), ("i1", "i2", "unclear")], "left_ref string, right_ref string, choice string")


def test_stumps_equal_plain_rounds(spark, monkeypatch):
    items, pairs, records, df = noisy_pairs(spark)
    directions = {"x": -1, "y": 1, "z": 0}
    want = plain_stumps(items, pairs, directions, 12, 3)
    for _ in range(2):  # on the driver, then on the cluster
        got = shapes.fit_boosted_stumps(df, records, directions, rounds=12)
        assert [(s.feature, s.threshold) for s in got] == [x[:2] for x in want]
        assert all(abs(s.low - x[2]) < 1e-9 and abs(s.high - x[3]) < 1e-9 for s, x in zip(got, want))
        monkeypatch.setattr(shapes, "LOCAL", 0)


def test_stumps_stop_on_games_set_aside(spark):
    _, _, records, df = noisy_pairs(spark)
    inside = df.join(records.select(F.col("item_ref").alias("left_ref"), F.col("game_id").alias("a")), "left_ref").join(records.select(F.col("item_ref").alias("right_ref"), F.col("game_id").alias("b")), "right_ref")
    stops = shapes.stop_groups(inside.where("a % 8 = b % 8"), records, "game_id")
    marked = {r.item_ref: r.stop for r in stops.collect()}
    linked = inside.where("a % 8 = b % 8").collect()
    assert linked and all(marked[r.left_ref] == marked[r.right_ref] for r in linked)
    assert not shapes.stop_groups(df, records.withColumn("game_id", F.col("game_id") % 3), "game_id").where("stop").count()  # too few groups
    fit = shapes.fit_boosted_stumps(inside.where("a % 8 = b % 8"), records, {"z": 0}, group="game_id", patience=2)
    assert len(fit) < 100


def test_tree_equals_plain_recursion(spark):
    items, pairs, records, df = noisy_pairs(spark)
    pull = dict.fromkeys(items, 0.0)
    for a, b, choice in pairs:
        t = {"left": 0.5, "right": -0.5, "tie": 0.0}[choice]
        pull[a] += t
        pull[b] -= t
    for directions in ({"x": -1, "y": 1, "z": 0}, {"x": 0, "y": -1}):
        want = plain_tree(items, pull, directions, 3, 4, -math.inf, math.inf)
        got = shapes.fit_monotone_tree(df, records, directions)
        for r in records.select("item_ref", got.column().alias("s")).collect():
            assert abs(r.s - walk(want, items[r.item_ref])) < 1e-9
    assert shapes.fit_monotone_tree(df.limit(0), records, {"x": 1}) == shapes.Node(0.0)


def test_families_compared_on_a_step(spark):
    """Utility jumps at 7: a family that bends must win over the line, and the tree may not win without two levels."""
    import random

    from tallyfield.operators import comparison

    r = random.Random(9)
    rows, pairs = [], []
    for g in range(240):
        kills = [r.randint(0, 15), r.randint(0, 15)]
        rows += [(f"{g}:{k}", g, float(x), None if k else 1.0) for k, x in enumerate(kills)]
        worth = [0.1 * x + (10 if x >= 7 else 0) for x in kills]
        pairs.append((f"{g}:0", f"{g}:1", "left" if worth[0] > worth[1] else "right" if worth[0] < worth[1] else "tie", "train" if g < 160 else "validation" if g < 200 else "test"))
    records = spark.createDataFrame(rows, "item_ref string, game_id long, kills double, other double")
    df = spark.createDataFrame(pairs, "left_ref string, right_ref string, choice string, split string")
    table, best = comparison.compare_families(records, df, {"kills": 1})
    got = {x.family: x for x in table.collect()}
    assert set(got) == set(comparison.FAMILIES) and all(x.validation_accuracy > 0.5 for x in got.values())
    assert [x.selected for x in got.values()].count(True) == 1 and got[best.family].test_accuracy > 0.8
    assert all(x.test_accuracy is None for x in got.values() if not x.selected)
    few, none = comparison.compare_families(records, df.where("split != 'train' or left_ref < '102'").where("left_ref != '0:0'").limit(12), {"kills": 1})
    assert none is None and {x.reason for x in few.collect()} == {"too_few_pairs"}


def test_report_has_every_measure(spark):
    from tallyfield.operators import comparison

    rows = [(g, f"{g}a", f"{g}b", "left" if g % 3 else "right", 1.0, 0.5, 0.6 + (g % 4) / 10, "top", "top" if g % 2 else "mid") for g in range(40)] + [(99, "x", "y", "tie", 1.0, 1.0, 0.5, None, None)]
    df = spark.createDataFrame(rows, "game_id long, left_ref string, right_ref string, choice string, left_score double, right_score double, p double, left_role string, right_role string").withColumn("confidence", F.col("p") / 2)
    got = {(r.metric, r.slice): r.value for r in comparison.report(df, {"role": "role"}, confidence="confidence").collect()}
    assert abs(got["accuracy", ""] - 26 / 40) < 1e-12 and (got["ties", ""], got["scored", ""]) == (1, 40)
    assert {k[1] for k in got if k[0] == "accuracy_by_role"} == {"top", "mixed", "unknown"}
    want = sum((0.6 + (g % 4) / 10 - (1.0 if g % 3 else 0.0)) ** 2 for g in range(40)) / 41
    assert abs(got["brier", ""] - want) < 1e-9 and got["resampled_low", ""] <= got["resampled_mean", ""] <= got["resampled_high", ""]
    assert sum(k[0] == "risk_at" for k in got) == 10


def test_rank_metrics_leave_incomplete_rows_out(spark):
    rows = [(1, float(i), 2.0 * i) for i in range(10)] + [(1, 11.0, None), (1, None, 3.0), (2, 1.0, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    assert [(r.n, round(r.pearson, 9)) for r in evaluation.pearson(df, "x", "y", "g").collect()] == [(10, 1.0)]
    assert [round(r.spearman, 9) for r in evaluation.spearman(df, "x", "y", "g").collect()] == [1.0]
    assert [r.tau_b for r in evaluation.kendall_tau_b(df, "x", "y", "g").collect()] == [1.0]


def test_inversions():
    import numpy as np

    from tallyfield.operators import order_statistics

    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 100, 333):
        v = r.integers(0, 20, n)
        assert order_statistics.weighted_inversions(v, np.ones(n)) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))


def test_training_set_counts_are_checked(spark, tmp_path):
    from tallyfield.operators import comparison

    one = spark.createDataFrame([(1,), (2,)], "a int")
    path = f"file://{tmp_path}/set"
    comparison.write_training_set(one, one.limit(1), path)
    assert [x.count() for x in comparison.read_training_set(spark, path)] == [2, 1]
    one.write.mode("append").parquet(f"{path}/pairs")
    with pytest.raises(ValueError, match="pairs"):
        comparison.read_training_set(spark, path)
