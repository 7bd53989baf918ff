from pyspark.sql import functions as F

from tallyfield.operators import advice, history, review


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (56.0, 55.0, 53.5, 51.0, 50.9, 44.0)], "w double")
    tier, label = advice.duo_tier(F.col("w"))
    assert [(r.t, r.l) for r in df.select(tier.alias("t"), label.alias("l")).collect()] == [("S", "Elite pairing")] * 2 + [("A", "Strong pairing"), ("B", "Solid pairing")] + [("C", "Playable pairing")] * 2
    df = spark.createDataFrame([(x,) for x in (52.0, 50.0, 48.0, 46.0, 45.9, None)], "w double")
    assert [r[0] for r in df.select(advice.matchup_label(F.col("w"))).collect()] == ["Favored", "Slightly Favored", "Even", "Slightly Unfavored", "Unfavored", None]


def test_partners_of_both_roles(spark):
    duos = spark.createDataFrame([("Jinx", f"s{i}", 100 + i, 45.0 + i) for i in range(8)] + [("Ashe", "s0", 50, 61.0), ("Ashe", "s1", 50, 60.0)], "champion string, partner string, games int, win_rate double")
    asked = spark.createDataFrame([("Jinx", "ADC"), ("s1", "support"), ("s0", "support"), ("Jinx", "mid"), ("x", "bot")], "champion string, role string")
    got = [(r.champion, r.partner, r.place) for r in advice.partners(asked, duos, 3).orderBy("champion", "place").collect()]
    assert got == [("Jinx", "s7", 1), ("Jinx", "s6", 2), ("Jinx", "s5", 3), ("s0", "Jinx", 1), ("s1", "Ashe", 1), ("s1", "Jinx", 2)]


def said(spark, a, e):
    names = ("ad", "ap", "mixed", "engage", "hard_cc", "soft_cc", "known")
    kind = ", ".join(f"{n}: int" for n in names)
    full = lambda x: tuple({**dict.fromkeys(names, 0), **x}.values())
    df = spark.createDataFrame([(1, full(a), full(e))], f"game_id int, a struct<{kind}>, e struct<{kind}>")
    return [(o.level, o.short, o.trait) for o in advice.draft_observations(df).first().observations]


def test_observations(spark):
    balanced = dict(ad=2, ap=2, mixed=1, engage=1, hard_cc=1, known=5)
    assert said(spark, balanced, balanced) == [] and said(spark, dict(ad=2, known=2), {}) == []
    assert said(spark, dict(ad=3, known=3), balanced) == [("warn", "No hard engage", "engage"), ("warn", "No hard CC", "hard_cc"), ("warn", "All AD, add magic dmg", "ap")]
    assert said(spark, {**balanced, "hard_cc": 0, "soft_cc": 2}, {**balanced, "engage": 2, "hard_cc": 3}) == [("warn", "Soft CC only, no lockdown", "hard_cc"), ("warn", "Enemy wombo, disengage+peel", None)]
    assert said(spark, {**balanced, "engage": 2, "hard_cc": 2}, dict(ap=3, hard_cc=4, known=3)) == [("info", "Enemy AP-heavy: buy MR", None), ("info", "4 hard CC: peel/tenacity", None), ("info", "Enemy no engage, group free", None), ("good", "Strong engage+CC, force it", None)]


def test_items_and_notes(spark):
    attributes = spark.createDataFrame([("A", "AD", "hard-aoe", True), ("M", "MIXED", "none", False), ("P", "AP", "soft", False)], "champion string, damage_type string, cc string, engage boolean")
    players = spark.createDataFrame([(1, i, 100 if i <= 5 else 200, c, g) for i, c, g in [(1, "A", 5000), (2, "A", 5000), (3, "A", 0), (4, "M", 0), (5, "?", 9000), (6, "P", 100)]], "game_id int, participant_id int, team_id int, champion string, gold int")
    items = spark.createDataFrame([(1, 900, 40, 0, True, []), (2, 900, 60, 0, True, []), (3, 700, 90, 0, True, []), (4, 900, 80, 0, False, []), (5, 900, 99, 0, True, ["Consumable"]), (6, 900, 0, 50, True, ["x"])], "item_id int, gold int, armor int, mr int, sr boolean, tags array<string>")
    got = {r.team_id: r for r in advice.item_advice(players, attributes, items).collect()}
    assert (got[200].primary, got[200].hard_cc, got[200].threat, list(got[200].armor_items), list(got[200].mr_items)) == ("armor", 3, "A", [2, 1], [])
    assert list(got[200].notes) == ["3 hard-CC threats", "A is the biggest item threat (physical)"]
    assert (got[100].primary, list(got[100].mr_items), list(got[100].notes)) == ("mr", [6], [])


def test_statuses_and_backfill(spark):
    ids = lambda *g: spark.createDataFrame([(x,) for x in g], "game_id long")
    rows = lambda n: spark.createDataFrame([(g, p) for g, k in n.items() for p in range(k)], "game_id long, participant_id int")
    routed = spark.createDataFrame([(g, "aggregate") for g in (2, 3, 4, 5, 6, 7)], "game_id long, source string")
    args = (ids(0, 1, 2, 3, 4, 5, 6, 6), ids(1, 2, 3, 4, 5, 6), routed, routed.where("game_id != 2"), rows({4: 9, 5: 10, 6: 10}), rows({5: 9, 6: 10}))
    got = {r.game_id: r.status for r in review.shadow_status(*args).collect()}
    assert got == {0: "error", 1: "no_supported_evidence", 2: "missing_feature_set", 3: "missing_v1_run", 4: "invalid_v1_run", 5: "error", 6: "scored"}
    assert {r.status for r in review.shadow_status(*args, artifacts=False).where("game_id > 2").collect()} == {"evidence_ready_no_artifact"}
    scores = spark.createDataFrame([(g, p, 1, 10 * p, p) for g in (1, 2) for p in (2, 1)], "game_id long, participant_id int, model_version int, total_score int, match_rank int")
    first = history.legacy_runs(scores, ids(2))
    again = history.legacy_runs(scores.orderBy("participant_id"), ids(2))
    assert first.collect() == again.collect() and [r.game_id for r in first.collect()] == [1]
    assert history.legacy_runs(scores, ids(1, 2)).count() == 0
