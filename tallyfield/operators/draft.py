"""Draft questions: matchup, duo and role statistics, lookups with fallbacks, role assignment, composition and items."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Win-rate bands in percent.
COUNTER_BAND = (50.0, 70.0)
MATCHUP_BAND = (25.0, 75.0)
DUO_BAND = (44.0, 60.0)
ROLES = ("top", "jungle", "mid", "bot", "support")


def band(rate: Column, limits: tuple[float, float], open_low: bool = False) -> Column:
    """The rate if it lies in the band, else null; what is no number is null."""
    x = rate.try_cast("double")
    low = x > limits[0] if open_low else x >= limits[0]
    return F.when(low & (x <= limits[1]), x)


def matchups(players: DataFrame, game: str = "game_id") -> DataFrame:
    """Games, wins and win rate per (champion, role, opponent), from the two players of a role in a match.

    Each (game, role) has two rows, which one aggregate brings together: no self join and nothing skewed to join.
    """
    side = lambda c: F.struct(c, "win")
    pair = players.groupBy(game, "role").agg(F.max(F.when(F.col("team_id") == 100, side("champion"))).alias("a"), F.max(F.when(F.col("team_id") == 200, side("champion"))).alias("b")).where("a is not null and b is not null")
    both = pair.select("role", F.explode(F.array(F.struct(F.col("a.champion").alias("champion"), F.col("b.champion").alias("opponent"), F.col("a.win").alias("win")), F.struct(F.col("b.champion").alias("champion"), F.col("a.champion").alias("opponent"), F.col("b.win").alias("win")))).alias("m"))
    return both.groupBy("m.champion", "role", "m.opponent").agg(F.count("*").alias("games"), F.count_if("m.win").alias("wins"), (F.count_if("m.win") * 100.0 / F.count("*")).alias("win_rate"))


def duos(players: DataFrame, first: str = "bot", second: str = "support", game: str = "game_id") -> DataFrame:
    """The same for two roles of one team."""
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("champion")))
    pair = players.where(F.col("role").isin(first, second)).groupBy(game, "team_id").agg(pick(first).alias("champion"), pick(second).alias("partner"), F.max("win").alias("win")).where("champion is not null and partner is not null")
    return pair.groupBy("champion", "partner").agg(F.count("*").alias("games"), F.count_if("win").alias("wins"), (F.count_if("win") * 100.0 / F.count("*")).alias("win_rate"))


def role_distribution(players: DataFrame) -> DataFrame:
    """Percent of a champion's games in each role."""
    per = players.groupBy("champion", "role").agg(F.count("*").alias("games"))
    return per.withColumn("pct", F.col("games") * 100.0 / F.sum("games").over(Window.partitionBy("champion")))


def primary_role(distribution: DataFrame) -> DataFrame:
    """The role with the largest share; ties go to the first in role order; without any share it is unknown."""
    order = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    best = distribution.groupBy("champion").agg(F.max_by("role", F.struct("pct", -order)).alias("role"), F.max("pct").alias("pct"))
    return best.withColumn("role", F.when(F.col("pct") > 0, F.col("role")).otherwise("unknown"))


def plausible(distribution: DataFrame) -> DataFrame:
    """Champions whose shares sum to 50-130 with fewer than two roles of 90 or more."""
    ok = distribution.groupBy("champion").agg(F.sum("pct").alias("s"), F.count_if(F.col("pct") >= 90).alias("n")).where("s between 50 and 130 and n < 2")
    return distribution.join(ok.select("champion"), "champion", "left_semi")


def repair_scale(distribution: DataFrame) -> DataFrame:
    """Shares given as fractions (a champion's peak is at most 1.5) become percent."""
    peak = F.max("pct").over(Window.partitionBy("champion"))
    return distribution.withColumn("pct", F.when(peak <= 1.5, F.round(F.col("pct") * 100, 2)).otherwise(F.col("pct")))


def overlay(fresh: DataFrame, static: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All keys of both; the fresh value wins."""
    return fresh.withColumnRenamed(value, "__f").join(static.withColumnRenamed(value, "__s"), keys, "full").select(*keys, F.coalesce("__f", "__s").alias(value))


def counters(table: DataFrame, curated: DataFrame, n: int = 5) -> DataFrame:
    """The n opponents that beat a champion in a role most often: derived from the matchup table, curated rows win."""
    derived = table.select("champion", "role", F.col("opponent").alias("counter"), (100 - F.col("win_rate")).alias("rate"))
    merged = overlay(curated, derived, ["champion", "role", "counter"], "rate").withColumn("rate", band(F.col("rate"), COUNTER_BAND, True)).where("rate is not null")
    w = Window.partitionBy("champion", "role").orderBy(F.desc("rate"), "counter")
    return merged.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def matchup_lookup(requests: DataFrame, table: DataFrame) -> DataFrame:
    """win_rate of (champion, role, opponent), or 100 minus that of the reverse matchup, if it lies in the band."""
    keys = lambda a, b: [F.lower(F.col(a).cast("string")), F.lower(F.col(b).cast("string"))]
    t = table.select(F.lower(F.col("champion").cast("string")).alias("a"), F.col("role").alias("r"), F.lower(F.col("opponent").cast("string")).alias("b"), F.col("win_rate").alias("w"))
    c, o = keys("champion", "opponent")
    one = requests.join(t, (c == F.col("a")) & (F.col("role") == F.col("r")) & (o == F.col("b")), "left").drop("a", "r", "b")
    two = one.join(t.withColumnRenamed("w", "w2"), (c == F.col("b")) & (F.col("role") == F.col("r")) & (o == F.col("a")), "left")
    return two.select(*requests.columns, band(F.coalesce("w", 100 - F.col("w2")), MATCHUP_BAND).alias("win_rate"))


def role_fallback(requests: DataFrame, table: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """For each request the row of its exact role, else the one with the highest priority."""
    t = table.withColumn("__exact", F.lit(0)).withColumnRenamed("role", "found_role")
    both = requests.join(t, keys, "left").withColumn("__exact", (F.col("found_role") == F.col("role")).cast("int"))
    best = F.max_by(F.struct(*[c for c in t.columns if c not in (*keys, "__exact")]), F.struct("__exact", priority, F.col("found_role")))
    return both.groupBy(*requests.columns).agg(best.alias("__b")).select(*requests.columns, "__b.*")


def assign_roles(teams: DataFrame, weights: str = "weights", minimum: float = 0.0) -> DataFrame:
    """The best of the 120 role permutations of each team.

    ``weights`` is an array of five maps or arrays of five doubles: a player's weight for each role in role order. A
    permutation whose players all have a weight beats one where some do not; then the larger sum wins, then the earlier
    permutation. All inside the row: no shuffle and no UDF.
    """
    perms = F.array(*[F.array(*[F.lit(i) for i in p]) for p in permutations(range(5))])
    weight = lambda p, k: F.get(F.get(F.col(weights), k), F.get(p, k))
    parts = lambda p: [weight(p, F.lit(k)) for k in range(5)]
    rated = F.transform(perms, lambda p, i: F.struct(sum((F.when(x > minimum, 0).otherwise(1) for x in parts(p)), F.lit(0)).alias("gaps"), (-sum(parts(p), F.lit(0.0))).alias("cost"), i.alias("i"), p.alias("p")))
    best = F.array_min(rated)
    names = F.array(*[F.lit(r) for r in ROLES])
    return teams.withColumn("roles", F.transform(best["p"], lambda k: F.get(names, k))).withColumn("weight", -best["cost"])


def composition(picks: DataFrame, attributes: DataFrame, *keys: str) -> DataFrame:
    """Counts of damage types, engage and crowd control per key; champions without attributes are unknown."""
    d = picks.join(F.broadcast(attributes), "champion", "left")
    kinds = lambda c, v: F.count_if(F.col(c) == v)
    return d.groupBy(*keys).agg(kinds("damage_type", "AD").alias("ad"), kinds("damage_type", "AP").alias("ap"), kinds("damage_type", "MIXED").alias("mixed"), F.count_if("engage").alias("engage"), F.count_if(F.col("cc").startswith("hard")).alias("hard_cc"), kinds("cc", "soft").alias("soft_cc"), F.count_if(F.col("damage_type").isNull()).alias("unknown"))


def threat(players: DataFrame, attributes: DataFrame, share: float = 0.68) -> DataFrame:
    """Per team what its enemies can do: (1000 + invested gold) by damage type, mixed split half; the answer to it."""
    d = players.join(F.broadcast(attributes.select("champion", "damage_type")), "champion", "left").withColumn("w", 1000 + F.col("gold"))
    of = lambda v: F.sum(F.when(F.col("damage_type") == v, F.col("w")).when(F.col("damage_type") == "MIXED", F.col("w") / 2).otherwise(0.0))
    per = d.groupBy("game_id", F.when(F.col("team_id") == 100, 200).otherwise(100).alias("team_id")).agg(of("AD").alias("physical"), of("AP").alias("magic"))
    part = F.try_divide("physical", F.col("physical") + F.col("magic"))
    return per.withColumn("answer", F.when(part >= share, "armor").when(part <= 1 - share, "mr").when(part.isNotNull(), "mixed"))


def suggest_picks(requests: DataFrame, champions: DataFrame, distribution: DataFrame, taken: DataFrame, n: int = 3, least: float = 12.0) -> DataFrame:
    """Per request (draft, role, trait) the n most played champions with the trait and enough of the role, not taken."""
    fit = requests.join(distribution.where(F.col("pct") >= least), "role").join(F.broadcast(champions), ["champion", "trait"]).join(taken, ["draft", "champion"], "left_anti")
    w = Window.partitionBy("draft", "role", "trait").orderBy(F.desc("pct"), "champion")
    return fit.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("draft", "role", "trait", "champion", "place")


def search(items: DataFrame, text: str, name: str = "name", n: int = 12) -> DataFrame:
    """First n names that hold the text, without case."""
    return items.where(F.lower(name).contains(text.lower())).orderBy(name).limit(n)
