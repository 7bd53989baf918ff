import random
from itertools import permutations

from tallyfield.operators import roles

SCHEMA = "id int, picks array<struct<name: string, weights: array<double>>>"


def plain(picks):
    """(confident, guesses) by role number, by going through all assignments."""
    known, order = {}, []
    for name, w in picks:
        if name not in order:
            order.append(name)
            if w:
                known[name] = w
    sure, maybe = {}, {}
    claims = {}
    for name in order:
        if name in known and max(known[name]) >= 85:
            claims.setdefault(known[name].index(max(known[name])), []).append(name)
    for r, names in claims.items():
        sure[r] = max(names, key=lambda n: max(known[n]))
    rest, free = sorted(n for n in known if n not in sure.values()), [r for r in range(5) if r not in sure]
    best = None
    for p in permutations(free, len(rest)):
        ws = [known[n][r] for n, r in zip(rest, p)]
        key = (all(w > 0 for w in ws), sum(ws))
        if best is None or key > best[0]:
            best = (key, p)
    for n, r in zip(rest, best[1]):
        if known[n][r] >= 35:
            sure[r] = n
        elif known[n][r] >= 10:
            maybe[r] = n
    for r in range(5):
        if r not in sure and r not in maybe:
            taken = {*sure.values(), *maybe.values()}
            left = [(w[r], n) for n, w in known.items() if n not in taken and w[r] >= 10]
            if left:
                maybe[r] = max(left)[1]
    return [sure.get(r) for r in range(5)], [maybe.get(r) for r in range(5)]


def run(spark, teams):
    got = roles.infer_roles(spark.createDataFrame(list(enumerate(teams)), SCHEMA)).collect()
    return {r.id: (list(r.confident), list(r.guesses)) if r.confident is not None else None for r in got}


def test_equals_all_assignments(spark):
    r = random.Random(1)
    weights = lambda: [float(r.choice([0, 0, 5, 10, 20, 35, 60, 85, 90])) for _ in range(5)]
    teams = [[(r.choice("abcdefg"), weights() if r.random() < 0.9 else None) for _ in range(r.randint(1, 5))] for _ in range(400)]
    teams = [[(n, next(w for m, w in t if m == n)) for n, _ in t] for t in teams]  # a name has one set of weights
    got = run(spark, teams)
    assert all(got[i] == plain(t) for i, t in enumerate(teams))


def test_two_claim_one_role(spark):
    garen, darius = [94.0, 6.0, 0.0, 0.0, 0.0], [88.0, 12.0, 0.0, 0.0, 0.0]
    assert run(spark, [[("Darius", darius), ("Garen", garen)]])[0] == (["Garen", None, None, None, None], [None, "Darius", None, None, None])


def test_odd_drafts(spark):
    got = run(spark, [[], [("x", None)], [("x", [0.0] * 5)], [(c, [50.0] * 5) for c in "abcdef"]])
    nothing = [None] * 5
    assert got == {0: (nothing, nothing), 1: (nothing, nothing), 2: (nothing, nothing), 3: None}
