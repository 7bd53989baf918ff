"""Roles of an unfinished draft: claims, the best assignment of the rest, and guesses, all inside the row."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.draft import ROLES

# Percent from which a champion claims its role, is placed for sure, and is guessed.
CLAIM, CONFIDENT, GUESS = 85.0, 35.0, 10.0


def _holder(items: Column, key) -> Column:
    """The name in the item with the largest key, null without any."""
    return F.array_max(F.transform(items, key))["name"]


def infer_roles(teams: DataFrame, picks: str = "picks") -> DataFrame:
    """Adds ``confident`` and ``guesses``: for each of five roles a champion's name or null.

    ``picks`` is an array of up to five (name, weights): weights are percent by role, null for an unknown champion. A name
    counts once. A champion whose best role (the first of equals) reaches CLAIM claims it; of several claimants the
    heavier gets it, of equals the earlier pick. The others are assigned to the free roles so that, first, none has weight 0, then the sum is
    largest, then in the order of names and roles; what they weigh there makes the placing sure, a guess or none. Roles still empty
    take, in order, the heaviest champion not placed yet, from GUESS on, of equals the later name. More than five picks give nulls.
    """
    weight = lambda p, r: F.coalesce(F.get(p["weights"], r), F.lit(0.0))
    once = F.filter(F.col(picks), lambda p, i: p["weights"].isNotNull() & (F.size(p["weights"]) > 0) & (F.array_position(F.transform(F.col(picks), lambda q: q["name"]), p["name"]) == i + 1))
    d = teams.withColumn("__known", F.transform(once, lambda p, i: F.named_struct(F.lit("name"), p["name"], F.lit("weights"), p["weights"], F.lit("i"), i, F.lit("best"), F.array_position(p["weights"], F.array_max(p["weights"])).cast("int") - 1, F.lit("top"), F.array_max(p["weights"]))))
    fits = F.size(F.col(picks)) <= 5
    roles = F.array(*[F.lit(r) for r in range(5)])

    claim = lambda r: _holder(F.filter("__known", lambda p: (p["best"] == r) & (p["top"] >= CLAIM)), lambda p: F.named_struct(F.lit("w"), p["top"], F.lit("i"), -p["i"], F.lit("name"), p["name"]))
    d = d.withColumn("__claimed", F.transform(roles, claim))
    d = d.withColumns({
        "__rest": F.array_sort(F.filter("__known", lambda p: ~F.exists("__claimed", lambda c: c.eqNullSafe(p["name"])))),
        "__free": F.filter(roles, lambda r: F.get("__claimed", r).isNull()),
    })

    orders = F.array(*[F.array(*[F.lit(i) for i in p]) for p in permutations(range(5))])
    n = F.size("__rest")
    at = lambda p, j: F.get("__free", F.get(p, j))
    usable = F.filter(orders, lambda p: F.forall(F.slice(p, F.lit(1), n), lambda x: x < F.size("__free")))

    def rated(p: Column, i: Column) -> Column:
        each = F.transform("__rest", lambda x, j: weight(x, at(p, j)))
        return F.named_struct(F.lit("gap"), F.exists(each, lambda w: w <= 0).cast("int"), F.lit("cost"), -F.aggregate(each, F.lit(0.0), lambda a, w: a + w), F.lit("i"), i, F.lit("p"), p)

    d = d.withColumn("__best", F.array_min(F.transform(usable, rated))["p"])
    placed = lambda r, low, high: F.array_max(F.filter(F.transform("__rest", lambda x, j: F.when((at(F.col("__best"), j) == r) & (weight(x, r) >= low) & (F.lit(True) if high is None else weight(x, r) < high), x["name"])), lambda x: x.isNotNull()))
    d = d.withColumns({
        "confident": F.when(fits, F.transform(roles, lambda r: F.coalesce(F.get("__claimed", r), placed(r, CONFIDENT, None)))),
        "__guessed": F.transform(roles, lambda r: placed(r, GUESS, CONFIDENT)),
    })

    def fill(seats: Column, r: Column) -> Column:
        free = F.filter("__known", lambda p: ~F.exists(seats, lambda s: s.eqNullSafe(p["name"])) & (weight(p, r) >= GUESS))
        chosen = _holder(free, lambda p: F.named_struct(F.lit("w"), weight(p, r), F.lit("name"), p["name"]))
        return F.transform(seats, lambda s, i: F.when((i == r) & s.isNull(), chosen).otherwise(s))

    seats = F.aggregate(roles, F.transform(roles, lambda r: F.coalesce(F.get("confident", r), F.get("__guessed", r))), fill)
    d = d.withColumn("__seats", F.when(fits, seats))
    guesses = F.transform(roles, lambda r: F.when(F.get("confident", r).isNull(), F.get("__seats", r)))
    return d.withColumn("guesses", F.when(fits, guesses)).drop("__known", "__claimed", "__rest", "__free", "__best", "__guessed", "__seats")


def named(roles: Column) -> Column:
    """role=champion of the filled roles, comma-joined."""
    return F.array_join(F.filter(F.transform(roles, lambda x, i: F.when(x.isNotNull(), F.concat_ws("=", F.get(F.array(*[F.lit(r) for r in ROLES]), i), x))), lambda x: x.isNotNull()), ",")
