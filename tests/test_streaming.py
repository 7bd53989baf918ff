import shutil

import duckdb
from pyspark.sql import functions as F

import tallyfield.plans  # noqa: F401
from tallyfield.catalog import QUERIES, SQL
from tallyfield.streaming import live
from tests.oracle import TABLES, compare

EVENTS = "session_id int, event_id int, ts timestamp, kind string"


def landed(spark, tmp_path, polls):
    """A poll per file; each repeats all events so far."""
    for i, rows in enumerate(polls):
        df = spark.createDataFrame(rows, EVENTS.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


def test_repeated_polls_count_once(spark, tmp_path):
    a, b = (1, 0, "2024-01-01 00:00:00", "Start"), (1, 1, "2024-01-01 00:00:05", "Kill")
    stream = landed(spark, tmp_path, [[a], [a, b], [a, b, (2, 0, "2024-01-01 00:00:05", "Start")]])
    got = live.run_available(live.exactly_once(stream), "t2").collect()
    assert sorted((r.session_id, r.event_id) for r in got) == [(1, 0), (1, 1), (2, 0)]


def test_unchanged_snapshots_are_dropped_as_in_batch(spark, tmp_path):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", k) for i, k in enumerate("aabbaac")]
    stream = landed(spark, tmp_path, [rows[:3], rows[3:]])
    got = live.run_available(live.changed_only(stream, digest="kind"), "t4").collect()
    want = live.changed_only_batch(spark.createDataFrame(rows, EVENTS.replace("timestamp", "string")), digest="kind").collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in want) == [0, 2, 4, 6]


def test_changed_snapshots_by_triggers_equal_batch(spark, tmp_path):
    rows = [(1 + i % 2, i, f"2024-01-01 00:00:{i:02d}", k) for i, k in enumerate(["a", None, "a", None, "b", "c", None, "c", None, "a", "b", "a", "b"])]
    rows += [(None, 50, "2024-01-01 00:00:50", "a"), (3, 51, "2024-01-01 00:00:51", None), (3, 52, "2024-01-01 00:00:52", "a")]
    stream = landed(spark, tmp_path, [rows[:3], rows[3:4], rows[4:11], rows[11:]])
    got = live.run_changed(stream, "t4", digest="kind")
    want = live.changed_only_batch(spark.createDataFrame(rows, EVENTS.replace("timestamp", "string")), digest="kind").collect()
    assert got.columns == stream.columns and sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want)
    assert live.run_changed(spark.readStream.schema(EVENTS).json(str(tmp_path / "in")).where("false"), "none", digest="kind").count() == 0


def test_snapshots_without_a_hash_equal_sql(spark, tmp_path):
    for t in TABLES:
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    (tmp_path / "events.parquet").unlink()
    rows = "select * replace (case when event_id % 3 = 0 then null else value end as value, user_id % 5 as user_id) from '/root/testdata/sf0.001/events.parquet'"
    duckdb.connect().execute(f"copy ({rows}) to '{tmp_path}/events.parquet'")
    assert compare(spark, QUERIES["t4_changed_snapshots"], SQL["t4_changed_snapshots"], tmp_path) > 0


def test_windows_progress_and_sessions_on_a_table(spark):
    rows = [(1, i, f"2024-01-01 00:{i:02d}:01", "Kill") for i in (0, 1, 2, 30)] + [(2, 9, "2024-01-01 00:00:01", "GameEnd")]
    df = spark.createDataFrame(rows, EVENTS.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
    assert live.throttled(df, 120).count() == 4
    assert {(r.session_id, r.last_event_id, r.events) for r in live.progress(df).collect()} == {(1, 30, 4), (2, 9, 1)}
    assert sorted((r.session_id, r.events, r.status) for r in live.sessions(df).collect()) == [(1, 1, "partial_silence"), (1, 3, "partial_silence"), (2, 1, "completed")]


def test_timers_and_reconciliation(spark):
    timers = (("dragon", 300, 300, None), ("grubs", 360, 240, 800), ("baron", 1200, 360, None))
    kills = spark.createDataFrame([(1, "dragon", 500), (1, "grubs", 700)], "session_id int, objective string, t int")
    got = {r.objective: (r.due, r.state) for r in live.objective_timers(kills, F.lit(600), timers).collect()}
    assert got == {"dragon": (800, "respawning"), "grubs": (940, "gone"), "baron": (1200, "pending")}
    s = spark.createDataFrame([(1, None), (2, 5), (3, 6), (4, 7)], "session_id int, game_id int")
    g = spark.createDataFrame([(1, 4), (2, 5), (3, 9)], "session_id int, game_id int")
    assert {r.session_id: (r.game_id, r.reconciliation) for r in live.reconcile(s, g).collect()} == {1: (4, "reconciled"), 2: (5, "reconciled"), 3: (6, "mismatch"), 4: (7, "open")}
