from pyspark.sql import functions as F

from tallyfield.operators import panel

ROWS = "game_id long, participant_id int, team_id int, champion string, role string, opponent_id int, features map<string,bigint>, duration long"


def players(spark, games=(1, 2, 3), change=lambda r: r):
    rows = [(g, p, 100 if p <= 5 else 200, f"C{p}", "mid", p + 5 if p <= 5 else p - 5, {"a.b": p, "c": g}, 1800) for g in games for p in range(1, 11)]
    return spark.createDataFrame([r for r in map(change, rows) if r], ROWS)


def made(spark, **k):
    return [x.cache() for x in panel.packets(players(spark, **k), "s", "r1")]


def test_packets_are_blind_whole_and_bound(spark):
    public, private, rejected = made(spark)
    assert rejected.count() == 0 and public.count() == private.count() == 6
    for p in public.collect():
        assert len({x.subject_id for x in p.participants}) == 10 and sorted(x.team for x in p.participants) == ["A"] * 5 + ["B"] * 5
        assert {x.opponent for x in p.participants} == {x.subject_id for x in p.participants}
        assert all(x.team != next(y.team for y in p.participants if y.subject_id == x.opponent) for x in p.participants)
    subjects = {r.subject_id for r in public.select(F.explode("participants.subject_id").alias("subject_id")).collect()}
    assert len(subjects) == 60  # no name in two rounds
    orders = {tuple(x.champion for x in p.participants) for p in public.collect()}
    assert len(orders) == 6
    assert panel.bundle_problems(public, private, "r1").count() == 0 and panel.packet_problems(public, "r1").count() == 0
    again, _, _ = made(spark)
    assert {r.packet_id for r in again.collect()} == {r.packet_id for r in public.collect()}


def test_rejected_games(spark):
    drop = lambda r: None if r[:2] == (1, 3) else (r[0], r[1], 300 if r[:2] == (2, 1) else r[2], *r[3:5], 11 if r[:2] == (3, 1) else r[5], *r[6:])
    _, _, rejected = made(spark, games=(1, 2, 3, 4), change=drop)
    assert sorted((r.game_id, r.reason) for r in rejected.collect()) == [(1, "participants"), (2, "teams"), (3, "opponent")]


def test_an_order_of_the_map_does_not_matter(spark):
    one = spark.sql("select map('a', 1L, 'b', 2L) m, map('b', 2L, 'a', 1L) n").select(panel.features_text(F.col("m")).alias("m"), panel.features_text(F.col("n")).alias("n")).first()
    assert one.m == one.n == "a=1,b=2"


def test_what_a_changed_bundle_shows(spark):
    public, private, _ = made(spark)
    ids = {(r.round, r.game_id): r.packet_id for r in private.collect()}
    first = F.col("packet_id") == ids["a", 1]
    lost = private.where(~first)
    got = panel.bundle_problems(public, lost, "r1").collect()
    assert {(r.packet_id, r.game_id, r.reason) for r in got} == {(ids["a", 1], None, "no_private"), (None, 1, "rounds")}
    moved = public.withColumn("participants", F.when(first, F.transform("participants", lambda p, i: F.when(i == 0, p.withField("champion", F.lit("X"))).otherwise(p))).otherwise(F.col("participants")))
    got = panel.bundle_problems(moved, private, "r1").collect()
    assert {(r.packet_id, r.game_id, r.reason) for r in got} == {(ids["a", 1], 1, "binding"), (None, 1, "evidence")}
    assert [(r.packet_id, r.reason) for r in panel.packet_problems(moved, "r1").collect()] == [(ids["a", 1], "body")]
    twice = public.unionByName(public.where(first))
    assert [(r.packet_id, r.reason) for r in panel.packet_problems(twice, "r1").collect()] == [(ids["a", 1], "duplicate")]
    assert {r.reason for r in panel.bundle_problems(twice, private, "r1").collect()} == {"duplicate_game"}
    assert {r.reason for r in panel.packet_problems(public, "r2").collect()} == {"rubric"}


def judged(spark, packet, **change):
    ids = [p.subject_id for p in packet.participants]
    one = lambda s: (s, 0.5, ["combat_impact"], ["a", "c"], "good")
    row = dict(packet_id=packet.packet_id, overall_confidence=0.5, abstain_reason=None, ranking_tiers=[ids[:4], ids[4:]], assessments=[one(s) for s in ids]) | change
    return spark.createDataFrame([tuple(row.values())], panel.JUDGMENT)


def test_judgments(spark):
    public, _, _ = made(spark, games=(1,))
    packet = public.where("round = 'a'").first()
    ids = [p.subject_id for p in packet.participants]
    only = public.where("round = 'a'")
    one = lambda s, c=0.5, tags=("combat_impact",), paths=("a.b",), text="good": (s, c, list(tags), list(paths), text)
    some = lambda **k: [one(s, **(k if i == 3 else {})) for i, s in enumerate(ids)]
    cases = [
        ({}, []), ({"abstain_reason": "no", "ranking_tiers": [], "assessments": []}, []), ({"abstain_reason": "no"}, ["abstained_with_content"]),
        ({"overall_confidence": 1.5}, ["overall_confidence"]), ({"overall_confidence": None}, ["overall_confidence"]),
        ({"ranking_tiers": [ids[:9]]}, ["ranking"]), ({"ranking_tiers": [ids, ids[:1]]}, ["ranking"]), ({"ranking_tiers": None}, ["ranking"]),
        ({"assessments": some()[:9]}, ["assessments"]), ({"assessments": some() + some()[:1]}, ["assessments"]), ({"assessments": some(c=-1.0)}, ["confidence"]),
        ({"assessments": some(tags=())}, ["no_tags"]), ({"assessments": some(tags=("luck",))}, ["unknown_tags"]), ({"assessments": some(paths=())}, ["path_count"]),
        ({"assessments": some(paths=("a",) * 7)}, ["path_count"]), ({"assessments": some(paths=("a.x",))}, ["unknown_path"]), ({"assessments": some(paths=("a", "a.b", "c"))}, []),
        ({"assessments": some(text="  ")}, ["brief_reason"]), ({"assessments": some(text="x" * 501)}, ["brief_reason"]), ({"packet_id": "other"}, ["missing", "unknown_packet"]),
    ]
    for change, want in cases:
        assert sorted(r.reason for r in panel.judgment_problems(judged(spark, packet, **change), only).collect()) == want, change
    twice = judged(spark, packet).unionByName(judged(spark, packet))
    assert [r.reason for r in panel.judgment_problems(twice, only).collect()] == ["duplicate"]


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"packet_id": "a", "overall_confidence": 1}\n\n{"packet_id": \n[]\nnull\n{"packet_id": "b"}\n')
    rows, bad = panel.read_lines(spark, str(tmp_path / "x.jsonl"), panel.JUDGMENT)
    assert sorted(r.packet_id for r in rows.collect()) == ["a", "b"] and bad.count() == 3
