from tallyfield.operators import panel
from tallyfield.plans import panel as plans


def test_packets_and_their_map_are_built_once(spark):
    public, private = plans._packets(spark, "/root/testdata/sf0.001")
    assert public.inputFiles() and sorted(public.inputFiles()) == sorted(private.inputFiles())
    assert not [f for f in public.inputFiles() if f.endswith(("lineitem.parquet", "orders.parquet"))]


def test_tampered_packets_are_made_without_a_join(spark):
    shown = plans._bundle(spark, "/root/testdata/sf0.001")[0]
    assert "Join" not in shown._jdf.queryExecution().executedPlan().toString() and shown.count() > 0


def test_packets_meet_their_map_once(spark, monkeypatch):
    public, private = plans._bundle(spark, "/root/testdata/sf0.001")
    plain, made = panel.stored, []
    monkeypatch.setattr(panel, "stored", lambda df, name: made.append(df) or plain(df, name))
    found = panel.bundle_problems(public, private, plans.RUBRIC)
    assert found.count() > 0 and found.inputFiles() and all("/bundle-" in f for f in found.inputFiles())
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and plan.count("Join FullOuter") == 1
