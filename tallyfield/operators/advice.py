"""Advice for drafts and games: observations on both sides, defensive items, partners, labels, and what a draft session says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators import draft

# Labels by win rate in percent.
DUO_TIERS = ((55.0, "S", "Elite pairing"), (53.0, "A", "Strong pairing"), (51.0, "B", "Solid pairing"), (None, "C", "Playable pairing"))
MATCHUP_LABELS = ((52.0, "Favored"), (50.0, "Slightly Favored"), (48.0, "Even"), (46.0, "Slightly Unfavored"), (None, "Unfavored"))
POSITIONS = {"TOP": "top", "JUNGLE": "jungle", "MIDDLE": "mid", "BOTTOM": "bot", "UTILITY": "support"}
LOPSIDED, ITEM_GOLD, BIG_GOLD = 0.68, 800, 4000


def _stepped(rate: Column, steps: list[tuple[float | None, str]]) -> Column:
    """The first step that the rate reaches; what is no number gets the last one."""
    out = F.lit(steps[-1][1])
    for least, name in reversed(steps[:-1]):
        out = F.when(rate >= least, name).otherwise(out)
    return out


def duo_tier(rate: Column) -> tuple[Column, Column]:
    """(letter, label)."""
    return tuple(_stepped(rate, [(s[0], s[k]) for s in DUO_TIERS]) for k in (1, 2))


def matchup_label(rate: Column) -> Column:
    return F.when(rate.isNotNull(), _stepped(rate, list(MATCHUP_LABELS)))


def partners(requests: DataFrame, duos: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best partners for each request (champion, role): of a bot its supports, of a support its bots.

    ``duos``: champion (bot), partner (support), games, win_rate. Rates outside the band are no partners; other roles have none.
    """
    role = F.when(F.lower("role") == "adc", "bot").otherwise(F.lower("role"))
    ways = F.explode(F.array(F.struct(F.lit("bot").alias("r"), F.col("champion").alias("own"), F.col("partner").alias("other")), F.struct(F.lit("support").alias("r"), F.col("partner").alias("own"), F.col("champion").alias("other"))))
    both = duos.withColumn("win_rate", draft.band(F.col("win_rate"), draft.DUO_BAND)).where("win_rate is not null").select(ways.alias("w"), "games", "win_rate").select("w.*", "games", "win_rate")
    w = Window.partitionBy("own", "r").orderBy(F.desc("win_rate"), "other")
    best = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    tier, label = duo_tier(F.col("win_rate"))
    asked = requests.withColumn("r", role).withColumnRenamed("champion", "own")
    return asked.join(best, ["own", "r"]).select(F.col("own").alias("champion"), "role", F.col("other").alias("partner"), "win_rate", "games", tier.alias("tier"), label.alias("tier_label"), "place")


def both_sides(composition: DataFrame) -> DataFrame:
    """(game_id, team_id, a, e): each team's composition and its enemy's, from one row a team (ids 100 and 200)."""
    row = F.struct(*[c for c in composition.columns if c not in ("game_id", "team_id")], (F.col("ad") + F.col("ap") + F.col("mixed")).alias("known"))
    of = lambda t: F.max(F.when(F.col("team_id") == t, row))
    pair = composition.groupBy("game_id").agg(of(100).alias("x"), of(200).alias("y"))
    nothing = F.col("x").isNull() | F.col("y").isNull()
    side = lambda t, a, e: F.struct(F.lit(t).alias("team_id"), F.col(a).alias("a"), F.col(e).alias("e"))
    return pair.where(~nothing).select("game_id", F.explode(F.array(side(100, "x", "y"), side(200, "y", "x"))).alias("s")).select("game_id", "s.*")


def draft_observations(sides: DataFrame) -> DataFrame:
    """Adds ``observations``, an array of (level, short, trait): gaps of the own side ``a``, reads of the enemy ``e``, both from three known champions on.

    trait is what a pick could add, null where none helps.
    """
    a, e = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"e.{c}"))
    say = lambda when, level, short, trait=None: F.when(when, F.struct(F.lit(level).alias("level"), (F.lit(short) if isinstance(short, str) else short).alias("short"), F.lit(trait).cast("string").alias("trait")))
    own, other = a("known") >= 3, e("known") >= 3
    only = lambda side, one, no: (side(no) == 0) & (side("mixed") == 0) & (side(one) >= 3)
    wombo = (e("engage") >= 2) & (e("hard_cc") >= 3)
    rules = [
        say(own & (a("engage") == 0), "warn", "No hard engage", "engage"),
        say(own & (a("hard_cc") == 0) & (a("soft_cc") >= 2), "warn", "Soft CC only, no lockdown", "hard_cc"),
        say(own & (a("hard_cc") == 0) & (a("soft_cc") < 2), "warn", "No hard CC", "hard_cc"),
        say(own & only(a, "ad", "ap"), "warn", "All AD, add magic dmg", "ap"),
        say(own & only(a, "ap", "ad"), "warn", "All AP, add AD threat", "ad"),
        say(other & only(e, "ad", "ap"), "info", "Enemy AD-heavy: buy armor"),
        say(other & only(e, "ap", "ad"), "info", "Enemy AP-heavy: buy MR"),
        say(other & wombo, "warn", "Enemy wombo, disengage+peel"),
        say(other & ~wombo & (e("hard_cc") >= 3), "info", F.concat(e("hard_cc").cast("string"), F.lit(" hard CC: peel/tenacity"))),
        say(other & ~wombo & (e("engage") >= 2), "info", F.concat(e("engage").cast("string"), F.lit(" engage tools, disengage"))),
        say(other & (e("engage") == 0), "info", "Enemy no engage, group free"),
        say(own & (a("engage") >= 2) & (a("hard_cc") >= 2), "good", "Strong engage+CC, force it"),
    ]
    return sides.withColumn("observations", F.array_compact(F.array(*rules)))


def trait_champions(attributes: DataFrame) -> DataFrame:
    """(champion, trait): what each champion could add to a side."""
    traits = F.array_compact(F.array(
        F.when(F.col("engage"), F.lit("engage")), F.when(F.col("cc").startswith("hard"), F.lit("hard_cc")),
        F.when(F.col("damage_type").isin("AP", "MIXED"), F.lit("ap")), F.when(F.col("damage_type").isin("AD", "MIXED"), F.lit("ad")),
    ))
    return attributes.select("champion", F.explode(traits).alias("trait"))


def item_advice(players: DataFrame, attributes: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
    """(game_id, team_id, primary, physical_share, hard_cc, threat, threat_gold, armor_items, mr_items, notes) against each team's enemies.

    Enemies weigh 1000 and their gold; mixed ones half each way; unknown champions are left out. From ``LOPSIDED`` on one resistance is
    advised, else both, each with the ``n`` items that give most of it (no consumables, ``ITEM_GOLD`` at least, the map's own).
    The biggest threat is the richest enemy, of equals the first participant.
    """
    d = players.join(attributes, "champion").withColumn("w", 1000 + F.col("gold"))
    kind = F.col("damage_type")
    of = lambda v: F.sum(F.when(kind == v, F.col("w")).when(kind == "MIXED", F.col("w") / 2).otherwise(0.0))
    richest = F.max_by(F.struct("champion", "damage_type", "gold"), F.struct("gold", -F.col("participant_id")))
    per = d.groupBy("game_id", F.when(F.col("team_id") == 100, 200).otherwise(100).alias("team_id")).agg(of("AD").alias("ad"), of("AP").alias("ap"), F.count_if(F.col("cc").startswith("hard")).alias("hard_cc"), richest.alias("t"))
    share = F.col("ad") / (F.col("ad") + F.col("ap"))
    primary = F.when(share >= LOPSIDED, "armor").when(1 - share >= LOPSIDED, "mr").otherwise("mixed")
    fit = items.where(F.col("sr") & (F.col("gold") >= ITEM_GOLD) & ~F.array_contains("tags", "Consumable"))
    top = lambda c: fit.where(F.col(c) > 0).orderBy(F.desc(c), "item_id").limit(n).agg(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("k"), "item_id"))).alias("l")).select(F.transform("l", lambda x: x["item_id"]).alias(f"{c}_best"))
    told = per.crossJoin(F.broadcast(top("armor"))).crossJoin(F.broadcast(top("mr")))  # one row each
    nothing = F.array().cast(told.schema["armor_best"].dataType)
    word = F.when(F.col("t.damage_type") == "AD", "physical").when(F.col("t.damage_type") == "AP", "magic").otherwise("mixed")
    notes = F.array_compact(F.array(F.when(F.col("hard_cc") >= 3, F.concat(F.col("hard_cc").cast("string"), F.lit(" hard-CC threats"))), F.when(F.col("t.gold") >= BIG_GOLD, F.concat(F.col("t.champion").cast("string"), F.lit(" is the biggest item threat ("), word, F.lit(")")))))
    return told.select("game_id", "team_id", primary.alias("primary"), share.alias("physical_share"), "hard_cc", F.col("t.champion").alias("threat"), F.col("t.gold").alias("threat_gold"), F.when(primary != "mr", F.col("armor_best")).otherwise(nothing).alias("armor_items"), F.when(primary != "armor", F.col("mr_best")).otherwise(nothing).alias("mr_items"), notes.alias("notes"))


def refreshed_weights(fresh: DataFrame, static: DataFrame) -> DataFrame:
    """(champion, role, pct): the fresh weights in percent where a champion's are plausible, over the static ones, champion by champion."""
    good = draft.plausible(draft.repair_scale(fresh))
    return good.unionByName(static.join(good.select("champion").distinct(), "champion", "left_anti"))


def assigned_positions(sessions: DataFrame) -> DataFrame:
    """(game_id, puuid, role) of both teams' players with a known position; sessions hold team_one and team_two."""
    roles = F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])
    empty = F.array().cast(sessions.schema["team_one"].dataType)
    players = sessions.select("game_id", F.explode(F.concat(F.coalesce("team_one", empty), F.coalesce("team_two", empty))).alias("p"))
    return players.select("game_id", F.col("p.puuid").alias("puuid"), F.try_element_at(roles, F.upper(F.coalesce("p.position", F.lit("")))).alias("role")).where("puuid != '' and role is not null")


def locked_partner(sessions: DataFrame) -> DataFrame:
    """Adds ``partner`` and ``partner_role``: the champion that the own lane partner has locked, null before.

    Sessions hold my_role, my_team (cell, position) and actions, a list of rounds of (cell, type, completed, champion_id). The partner is the first
    team-mate in the other role of the bottom lane; hovering is no lock.
    """
    other = F.when(F.col("my_role") == "bot", "support").when(F.col("my_role") == "support", "bot")
    roles = F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])
    cell = F.get(F.filter("my_team", lambda p: F.try_element_at(roles, F.upper(F.coalesce(p["position"], F.lit("")))) == other), F.lit(0))["cell"]
    locked = F.get(F.filter(F.flatten("actions"), lambda x: (x["cell"] == cell) & (x["type"] == "pick") & F.coalesce(x["completed"], F.lit(False)) & (x["champion_id"] > 0)), F.lit(0))["champion_id"]
    return sessions.withColumn("partner", locked).withColumn("partner_role", F.when(F.col("partner").isNotNull(), other))
