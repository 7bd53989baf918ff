import random

from tallyfield.operators import builds


def plain(seq, ranks, level, priority):
    ranks = {a: ranks.get(a, 0) for a in "QWER"}
    seen = dict.fromkeys("QWER", 0)
    for a in [x for x in seq or [] if x in seen]:
        seen[a] += 1
        if seen[a] > ranks[a]:
            return a
    if min(ranks[a] for a in "QWE") >= 5 and ranks["R"] >= 3:
        return None
    target = max(level or 0, sum(ranks.values()) + 1)
    if ranks["R"] < sum(target >= x for x in (6, 11, 16)):
        return "R"
    order = [x for x in priority or [] if x in ("Q", "W", "E")]
    order += [x for x in "QWE" if x not in order]
    for cap in (min(5, (target + 1) // 2), 5):
        for a in order:
            if ranks[a] < cap:
                return a
    return "R" if ranks["R"] < 3 else None


def test_next_step(spark):
    r = random.Random(9)
    rows = []
    for i in range(600):
        seq = r.choice([None, [], [r.choice("QWERX") for _ in range(r.randint(1, 18))]])
        rows.append((i, seq, {a: r.randint(0, 5 if a != "R" else 3) for a in "QWER" if r.random() < 0.9}, r.choice([None, r.randint(1, 18)]), r.choice([None, ["W", "Q", "E"], ["E", "x"]])))
    rows += [(600, None, dict(Q=5, W=5, E=5, R=3), 18, None), (601, list("QWEQQR"), dict(Q=5, W=5, E=5, R=3), 18, None)]
    got = {x.id: x.next_step for x in builds.next_step(spark.createDataFrame(rows, "id int, sequence array<string>, ranks map<string,int>, level int, priority array<string>")).collect()}
    assert got == {i: plain(*x) for i, *x in rows} and got[600] is None


def test_build_records(spark):
    whole = '{"rune_pages": [{"builds": [{"primary_page_id": 1, "primary_rune_ids": [1, "2", 3, 4], "secondary_rune_ids": [5, 6], "stat_mod_ids": [7, 8, 9, 10]}]}], "last_items": [{"ids": [11]}, {"ids": []}, {"x": 1}, {"ids": [12]}]}'
    texts = [whole, whole.replace("[7, 8, 9, 10]", "null"), "[]", "{", None, '{"rune_pages": null}', '{"rune_pages": [{}]}', '{"rune_pages": [{"builds": [{"primary_rune_ids": 5}]}]}']
    got = {r.id: r for r in builds.build_records(spark.createDataFrame(list(enumerate(texts)), "id int, payload string")).collect()}
    assert [got[i].problem for i in range(8)] == [None, None, "no_rune_pages", "not_json", "not_json", "no_rune_pages", "no_build", "runes"]
    assert got[0].rune_ids == [1, 2, 3, 4, 5, 6, 7, 8, 9] and got[0].items_fourth == [11] and (got[0].primary_style_id, got[0].sub_style_id) == (1, 8100)
    assert got[1].rune_ids[6:] == list(builds.SHARDS) and got[0].spells == [] and got[7].rune_ids is None
    shape = builds.payload_shapes(spark.createDataFrame(list(enumerate(texts)), "id int, payload string")).first()
    assert (shape.payloads, shape.unread) == (8, 2)
    same = builds.payload_shapes(spark.createDataFrame(list(enumerate(texts[:2])), "id int, payload string")).first()
    assert "primary_rune_ids: ARRAY" in same["shape"] and "stat_mod_ids: ARRAY<BIGINT>" in same["shape"]
