import json

from pyspark.sql import functions as F

from tallyfield.operators import corpus
from tallyfield.sources import ingest as ig


def match(i, **info):
    positions = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]
    players = [{"participantId": k + 1, "puuid": f"{i}-{k}", "teamId": 100 if k < 5 else 200, "championId": k, "championName": f"C{k}", "teamPosition": positions[k % 5], "kills": k, "goldEarned": {"$numberLong": "900"}, "totalMinionsKilled": 5, "neutralMinionsKilled": 2, "item0": 3, "item3": 0, "item6": 9, "win": k < 5} for k in range(10)]
    return {"metadata": {"matchId": f"NA1_{i}"}, "info": {"gameId": i, "queueId": 420, "mapId": 11, "gameDuration": 1800, "gameCreation": {"$numberLong": "1700000000000"}, "gameVersion": "14.3.1.2", "participants": players} | info}


def test_normalise_and_reasons(spark, tmp_path):
    docs = [match(1), match(2, queueId=1700), match(3, gameDuration=200), match(4), match(5, mapId=12), match(6), match(7)]
    docs[3]["info"]["participants"] = docs[3]["info"]["participants"][:9]
    docs[5]["info"]["participants"][2]["teamPosition"] = ""
    docs[6]["info"]["participants"][1]["puuid"] = "7-0"
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, docs)) + "\n{broken\n")
    df = ig.read_documents(spark, f"file://{tmp_path}/m.json", ig.MATCH)
    got = {r.reason: r.documents for r in ig.tally(ig.rejection(df)).collect()}
    assert got == {"accepted": 1, "queue": 1, "too_short": 1, "participant_count": 1, "map": 1, "roles": 1, "identity": 1, "unreadable": 1}
    rows = ig.normalise(df, "salt").orderBy("participant_id").collect()
    assert [r.participant_id for r in rows] == list(range(1, 11)) and {r.game_id for r in rows} == {1}
    one = rows[3]
    assert (one.kills, one.gold_earned, one.cs, one.items, one.role, one.patch, one.duration) == (3, 900, 7, [3, 9], "bot", "14.3", 1800)
    assert str(one.creation).startswith("2023-11-14") and one.puuid.startswith("p_") and one.name == "Player 4"


def test_timelines(spark, tmp_path):
    events = [{"type": "CHAMPION_KILL", "timestamp": 60000.0, "killerId": 1, "victimId": 6, "assistingParticipantIds": [2], "position": {"x": 100, "y": 100}}, {"type": "SKILL_LEVEL_UP", "timestamp": 1.0}, {"type": "WARD_PLACED", "timestamp": 61000.0, "creatorId": 4}]
    frames = [{"timestamp": t * 60000.0, "events": events if t == 1 else None, "participantFrames": {str(p): {"participantId": p, "currentGold": 5, "totalGold": 500 * t if p > 1 else None, "position": {"x": 1, "y": 2}} for p in range(1, 11)}} for t in range(3)]
    (tmp_path / "t.json").write_text(json.dumps({"metadata": {"matchId": "NA1_1"}, "info": {"frames": frames}}))
    df = ig.read_documents(spark, f"file://{tmp_path}/t.json", ig.TIMELINE)
    e = ig.canonical_events(df).orderBy("event_order").collect()
    assert [(r.kind, r.killer, r.victim, r.assists) for r in e] == [("champion_kill", 1, 6, [2]), ("ward_placed", 4, None, [])]
    f = ig.canonical_frames(df)
    assert f.count() == 30 and {r.gold for r in f.where("t_ms = 60000").collect()} == {5, 500}
    d = spark.createDataFrame([("NA1_1", 120)], "match_id string, duration int")
    assert ig.completeness(f, d).collect()[0][1:] == (1.0, True)


def test_scalars(spark):
    df = spark.createDataFrame([("5",), ('{"$numberLong": "7"}',), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(ig.number(F.col("v"))).collect()] == [5, 7, None, None]
    ids = spark.createDataFrame([("NA1_5",), ("XX_5",), ("no",)], "m string").select(ig.match_id(F.col("m")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in ids] == [("NA1", 5, "americas"), (None, 5, None), (None, None, None)]


def test_leak_scans(spark):
    df = spark.createDataFrame([(1, '{"a": {"teamWin": 1}, "match-result": 2, "window": 3}')], "id int, j string")
    assert {r.key for r in corpus.leaked_keys(df, "j", "id").collect()} == {"teamWin", "match-result"}
    assert corpus.leaked_fields(spark.createDataFrame([], "a int, s struct<isWinner: int, winner: int, x: array<struct<lost: int>>>").schema) == ["s.isWinner", "s.winner", "s.x.lost"]
