import random

import pytest
from pyspark.sql import functions as F

from tallyfield.streaming import capture

POLL = "session_id long, ts string, reachable boolean, stored boolean, events int, snapshot boolean, stop boolean"
SECOND = 1_000_000


def plain(polls, max_misses, silence):
    """(session, started, ended, status) by going through the polls in order of time."""
    out, by = [], {}
    for s, t, *rest in sorted(polls, key=lambda p: p[1]):
        by.setdefault(s, []).append((t, *rest))
    for s, rows in by.items():
        run = []

        def end(status):
            out.append((s, run[0][0], run[-1][0], status))
            run.clear()

        for row in rows:
            if run and row[0] - run[-1][0] > silence:
                end("partial_process_restart")
            run.append(row)
            misses = 0
            for x in reversed(run):
                if x[1]:
                    break
                misses += 1
            if row[5] or misses >= max_misses:
                kept = [x for x in run if x[1] and x[2]]
                lost = any(x[1] and not x[2] for x in run)
                if not any(x[3] or x[4] for x in kept):
                    end("partial_storage_errors" if lost else "partial_no_data")
                else:
                    end("partial_endpoint_lost" if misses >= max_misses else "partial_storage_errors" if lost else "completed")
        if run:
            end("partial_process_restart")
    return sorted(out)


def run(spark, tmp_path, polls, pieces, max_misses, silence):
    """The polls arrive in pieces one after the other, and a day later one of no session, which lets all timers expire."""
    polls = sorted(polls, key=lambda p: p[1])
    size = -(-len(polls) // pieces)
    parts = [polls[i : i + size] for i in range(0, len(polls), size)] + [[(None, polls[-1][1] + 86_400, None, None, None, None, None)]]
    for i, part in enumerate(parts):
        random.Random(i).shuffle(part)
        df = spark.createDataFrame([(p[0], None, *p[2:], p[1]) for p in part], f"{POLL}, s long")
        df.withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(POLL.replace("ts string", "ts timestamp")).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = capture.run_lifecycle(source, max_misses=max_misses, silence=silence).collect()
    return sorted((r.session_id, r.started // SECOND, r.ended // SECOND, r.status) for r in got), got


@pytest.mark.parametrize("pieces", [1, 4])
def test_every_status(spark, tmp_path, pieces):
    polls = [
        (1, 1000, True, True, 3, False, False), (1, 1002, True, True, 0, True, True),
        (2, 1000, True, True, 1, False, False), *[(2, 1005 + 5 * i, False, True, 0, False, False) for i in range(3)],
        (3, 1000, True, True, 0, False, False), (3, 1002, True, True, 0, False, True),
        (4, 1000, True, False, 2, True, False), (4, 1002, True, True, 0, False, True),
        (5, 1000, True, True, 2, False, False), (5, 1002, True, False, 1, False, False), (5, 1004, True, True, 0, False, True),
        (6, 1000, True, True, 2, False, False), (6, 1700, True, True, 2, False, False),
        (7, 1000, None, None, 4, None, None), (7, 1020, False, True, 0, False, True),
    ]
    got, rows = run(spark, tmp_path, polls, pieces, 3, 600)
    assert got == plain([tuple(p if p is not None else d for p, d in zip(x, (0, 0, True, True, 0, False, False))) for x in polls], 3, 600)
    assert {s: status for s, _, _, status in got if s != 6} == {1: "completed", 2: "partial_endpoint_lost", 3: "partial_no_data", 4: "partial_storage_errors", 5: "partial_storage_errors", 7: "completed"}
    assert [x[1:] for x in got if x[0] == 6] == [(1000, 1000, "partial_process_restart"), (1700, 1700, "partial_process_restart")]
    assert [(r.polls, r.events, r.snapshots, r.store_errors) for r in rows if r.session_id == 5] == [(3, 2, 0, 1)]


def test_random_polls_in_many_pieces(spark, tmp_path):
    r = random.Random(3)
    polls = [(r.randint(1, 12), t, r.random() < 0.6, r.random() < 0.8, r.choice([0, 0, 1]), r.random() < 0.2, r.random() < 0.05) for t in r.sample(range(100_000), 600)]
    got, _ = run(spark, tmp_path, polls, 3, 3, 2500)
    assert got == plain(polls, 3, 2500) and len({x[3] for x in got}) == 5


class Handle:
    """A handle and its one state, which counts what it is asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def __getattribute__(self, name):
        if name in ("get", "exists", "update", "clear", "listTimers", "registerTimer", "deleteTimer"):
            self.asked += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_trigger_asks_the_store_four_times_at_most():
    handle, machine = Handle(), capture.CaptureMachine(3, 600)
    machine.init(handle)
    poll = lambda second, stop=False: dict(t=second * SECOND, reachable=True, stored=True, events=1, snapshot=False, stop=stop)
    for polls, out, timers, most in (([poll(2), poll(1)], 0, {602_001}, 3), ([poll(700)], 1, {1_300_001}, 4), ([poll(800, True)], 1, set(), 3)):
        before = handle.asked
        assert len([*machine.handleInputRows((1,), iter(polls), None)]) == out
        assert handle.timers == timers and handle.asked - before <= most
    assert handle.value is None
