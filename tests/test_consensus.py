from tallyfield.operators import corpus


def test_a_panel_is_exchanged_once(spark):
    tiers = [("m", r, v, i, t, 60 + i) for v in (1, 2) for r in (1, 2) for i, t in ((1, 0), (2, 3))] + [("m", 1, 3, 1, 4, 60), ("m", 1, 3, 2, 0, 60), ("m", 2, 1, 3, None, None)]
    found = corpus.panel_consensus(spark.createDataFrame(tiers, "match string, round int, reviewer int, item int, tier int, confidence int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in found.collect()] == [("m", 1, 2, 1, 2, 61)]
