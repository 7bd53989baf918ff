from pyspark.sql import functions as F

from tallyfield.operators import comparison, shapes
from tallyfield.plans import models

SF = "/root/testdata/sf0.001"


def read(*frames):
    return [f.rsplit("/", 2)[-2:] for df in frames for f in df.inputFiles()]


def test_fits_read_what_was_written_once(spark):
    p, pairs, _ = models._training(spark, SF)
    names = [x for path in read(p, pairs) for x in path]
    assert not {"lineitem.parquet", "orders.parquet"} & set(names)
    assert p.count() == 1500 and pairs.count() == 750


def test_features_that_lie_by_game_are_not_exchanged_again(spark):
    features = spark.createDataFrame([(1, "a", 1, 1, 1, 5), (1, "a", 2, 1, 1, 6), (1, "b", 1, 1, 1, 7), (2, "a", 1, 1, 1, 8)], "game_id long, source string, version int, created_at int, participant_id int, kills int").repartition("game_id")
    manifest = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "game_id long, source string")
    splits = spark.createDataFrame([(1, "train")], "game_id long, split string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = comparison.training_records(manifest, features, splits)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [(r["item_ref"], r["kills"], r["split"]) for r in found.collect()] == [("1:1:a", 6, "train")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") <= 3  # one each of features, manifest and splits


def test_families_read_what_was_written_once(spark):
    p, pairs, _ = models._split_training(spark, SF)
    assert not {"lineitem.parquet", "orders.parquet"} & {x for path in read(p, pairs) for x in path}
    assert pairs.groupBy("split").count().count() == 3


def test_stumps_read_the_games_set_aside_from_what_was_written_once(spark, monkeypatch):
    p, pairs, names = models._training(spark, SF)
    seen, binned = [], shapes._binned_pairs
    monkeypatch.setattr(shapes, "_binned_pairs", lambda *a: seen.append(a[-1]) or binned(*a))
    assert shapes.fit_boosted_stumps(pairs, p, names, rounds=1, group="game_id") is not None
    assert seen[0].inputFiles() and all("/stops-" in f for f in seen[0].inputFiles())


def test_families_are_fitted_and_judged_without_joining_pairs_again(spark, monkeypatch):
    p, pairs, names = models._split_training(spark, SF)
    judged, binned, accuracy, cut_pairs = [], [], comparison.ev.pairwise_accuracy, shapes._binned_pairs
    monkeypatch.setattr(comparison.ev, "pairwise_accuracy", lambda df: judged.append(df) or accuracy(df))
    monkeypatch.setattr(shapes, "_binned_pairs", lambda *a: binned.append(a[0]) or cut_pairs(*a))
    comparison.compare_families(p, pairs, names)
    assert len(judged) == 5 and len(binned) == 1
    for df in [*judged, *binned]:
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
        assert all("/ended-" in f for f in df.inputFiles())


def test_items_named_by_several_pairs_are_drawn_by_all_of_them(spark):
    from tallyfield.operators import models as m

    records = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("d", 4)], "item_ref string, x int")
    pairs = spark.createDataFrame([("a", "b", "left"), ("a", "c", "right"), ("b", "a", "tie"), ("a", "none", "left"), ("c", "c", "unclear")], "left_ref string, right_ref string, choice string")
    ended = m.pair_ends(pairs, records, ["x"])
    assert ended.count() == 5 and m.whole_pairs(ended).count() == 4
    assert {(r["item_ref"], r["x"], r["t"]) for r in m.end_items(ended, ["x"]).collect()} == {("a", 1, 0.0), ("b", None, -0.5), ("c", 3, 0.5)}
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(m.end_differences(ended, {"x": F.col("x")})) == key(m.pair_differences(pairs, records, ["x"]))
