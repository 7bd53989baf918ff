from pyspark.sql import functions as F

from tallyfield.operators.refresh import EVIDENCE, RUNS, EvidenceRefresh
from tallyfield.session import scratch

ARTIFACTS = {"match_v5": (2, {"kills": 1.0}), "live_client": (1, {"kills": 0.5}), "aggregate": (1, {"kills": 0.1})}


def players(spark, games):
    rows = [(g, p, "mid", (g * p) % 7) for g in games for p in range(1, 11)]
    return spark.createDataFrame(rows, "game_id long, participant_id int, role string, kills int")


def worker(spark, name, buckets=8):
    return EvidenceRefresh(spark, scratch(spark, name), ARTIFACTS, buckets=buckets)


def land(w, rows):
    w.land(w.spark.createDataFrame(rows, EVIDENCE))


def scores(w):
    return sorted((r.game_id, r.participant_id, r.tier, r.completeness, r.score, r.model_rank) for r in w.active_scores().collect())


def active(w):
    return {r.game_id: r.tier for r in w.active_scores().select("game_id", "tier").distinct().collect()}


def test_three_batches_equal_one_refresh(spark):
    every = players(spark, range(30))
    of = lambda changed: every.join(changed, "game_id", "left_semi")
    batches = [[(g, "aggregate", g, 1.0, g) for g in range(30)], [(g, "live_client", g, 0.5 + g / 100, g) for g in range(0, 30, 3)], [(g, "match_v5", g, 0.9, g) for g in range(0, 30, 5)]]
    part, whole = worker(spark, "part"), worker(spark, "whole")
    for rows in batches:
        land(part, rows)
        part.refresh(of)
    land(whole, [x for rows in batches for x in rows])
    whole.refresh(of)
    assert scores(part) == scores(whole) and len(scores(part)) == 300
    assert active(part) == {g: "match_v5" if g % 5 == 0 else "live_client" if g % 3 == 0 else "aggregate" for g in range(30)}


def test_only_changed_games_and_partitions_are_touched(spark):
    w = worker(spark, "touched")
    asked = []
    every = players(spark, range(40))

    def of(changed):
        asked.append(sorted(r.game_id for r in changed.collect()))
        return every.join(changed, "game_id", "left_semi")

    land(w, [(g, "aggregate", g, 1.0, g) for g in range(40)])
    w.refresh(of)
    files = set(w.store.read("active", "game_id long").inputFiles())
    asked.clear()
    land(w, [(7, "live_client", 1, 0.5, 1)])
    assert [(r.game_id, r.status) for r in w.refresh(of).collect()] == [(7, "scored")]
    assert asked[0] == [7]
    bucket = spark.range(1).select(F.lit(7).cast("long").alias("game_id")).select(w.store.bucket().alias("b")).first().b
    left = set(w.store.read("active", "game_id long").inputFiles())
    assert {f for f in files ^ left if f"bucket={bucket}/" not in f} == set() and files != left
    read = w.store.read("runs", RUNS, [bucket])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(read.select("bucket").distinct().collect()) == 1
    assert all(f"bucket={bucket}/" in r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect())
    asked.clear()
    assert w.refresh(of).collect() == [] and asked[0] == []


def test_a_refresh_that_is_repeated_changes_nothing_and_tiers_never_fall(spark):
    w = worker(spark, "again")
    of = lambda changed: players(spark, range(3)).join(changed, "game_id", "left_semi")
    land(w, [(0, "match_v5", 1, 0.8, 1), (1, "lcu_timeline", 1, 1.0, 1), (9, "aggregate", 1, 1.0, 1)])
    marks = w.marks()
    assert {r.game_id: r.status for r in w.refresh(of).collect()} == {0: "scored", 1: "scored", 9: "no_rows"}
    before, n = scores(w), w.store.read("runs", RUNS).count()
    w.marks = lambda: marks  # as if the run had died before it wrote them
    w.refresh(of)
    assert scores(w) == before and w.store.read("runs", RUNS).count() == n
    del w.marks
    land(w, [(0, "match_v5", 2, 0.0, 2), (0, "live_client", 5, 1.0, 3)])
    w.refresh(of)
    assert active(w)[0] == "match_v5" and scores(w) == before
    assert w.store.read("runs", RUNS).count() == n + 10


def test_without_a_model_for_the_evidence(spark):
    w = EvidenceRefresh(spark, scratch(spark, "none"), {"match_v5": (1, {"kills": 1.0})}, buckets=4)
    land(w, [(0, "live_client", 1, 0.8, 1)])
    assert [(r.status, r.run_id) for r in w.refresh(lambda c: players(spark, [0]).join(c, "game_id", "left_semi")).collect()] == [("no_artifact", None)]
    assert scores(w) == []
