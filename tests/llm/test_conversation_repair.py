import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tallyfield.llm import conversation_repair as cr

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit, turns) of (role, text, must go, truncated) rows, by recursion over all edits."""

    @cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        need = "assistant" if state == 2 else "user"
        if inserts < 2:
            c, a, t = best(i, 3 if state == 2 else 2, inserts + 1)
            found.append((c + 2, "I" + a, ((need, ""), *t)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, t))
            if not gone:
                c, a, t = best(i + 1, 3 if state == 2 else 2, 0)
                found.append((c + 2 + cut, "R" + a, ((need, text), *t)))
                if (state, role[:1]) in STEP:
                    c, a, t = best(i + 1, STEP[state, role[:1]], 0)
                    found.append((c + cut, "K" + a, ((role, text), *t)))
        return min(found, default=(1 << 30, "", ()))

    return best(0, 0, 0)


def plain(turns, harm=True):
    """The dealt result by conversation from (conv_id, turn, role, text) rows."""
    convs = {}
    for c, t, role, text in turns:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if harm else 9
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if d == 4 else role
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        convs.setdefault(c, []).extend([(t, role, text)] * (0 if d == 0 else 2 if d == 3 else 1))
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        dated = [t for t, _, _ in rows if t is not None]
        counts, seen, edit = dict(blank=0, duplicate=0, truncated=0), set(), []
        for _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            edit.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, fixed = cheapest(tuple(edit))
        gaps = max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0
        out[c] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def ours(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def run(spark, turns, harm=True, piece=512, tail=4096):
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, part string, n int")
    return ours(cr.digest(cr.repair(cr.damage(df) if harm else df, piece, tail)))


def random_turns(seed, convs, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut", " ", "", "a. ", "b?\t", "é", None]
    out = []
    for c in range(convs):
        turn = 0
        for _ in range(r.randint(1, most)):
            out.append((c, None if r.random() < 0.05 else turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(texts)))
            turn += r.choice([0, 1, 1, 2])
    return out


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("piece, tail", [(512, 4096), (3, 5)])
def test_equals_brute_force(spark, many_tasks, piece, tail):
    turns = random_turns(1, 150, 9) + random_turns(2, 3, 60)[-120:]
    assert run(spark, turns, True, piece, tail) == plain(turns)
    assert run(spark, turns, False, piece, tail) == plain(turns, harm=False)


@pytest.mark.parametrize("piece, tail", [(16, 64), (7, 10), (1, 1)])
def test_one_long_conversation_over_many_tasks(spark, many_tasks, piece, tail):
    r = random.Random(5)
    long = [(7, t, r.choice(["user", "assistant", "system"]), r.choice([f"Text {t}.", f"text {t}", "Same.", "", "Same!"])) for t in range(250)]
    turns = long + [(8, 0, "user", "Same.")] * 40 + [(None, None, "assistant", "Same.")] * 3 + [(6, t, "user", "Hi.") for t in range(50)]
    got = run(spark, turns, False, piece, tail)
    assert got == plain(turns, harm=False)
    assert got[8][1:3] == (0, 39) and got[6][2] == 49


def test_whole_table_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = ours(cr.digest(cr.repair(cr.damage(df))))
    assert got == plain([(x.conv_id, x.turn, x.role, x.text) for x in df.collect()])
    assert sum(x[5] > 0 for x in got.values()) > 20


def test_odd_tables(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    got = run(spark, [(dropped, 0, "user", "Hi."), (None, None, None, None)])
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[None][-1] == empty and got[None][1] >= 1
    assert run(spark, []) == {}
    huge = [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "Done.")]
    assert run(spark, huge, harm=False) == plain(huge, harm=False)
