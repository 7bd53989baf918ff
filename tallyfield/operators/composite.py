"""The percentile composite: all participants of a group scored against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the five components by role bucket.
WEIGHTS = {
    "lane": {"combat": 0.35, "economy": 0.25, "objectives": 0.15, "vision": 0.10, "teamplay": 0.15},
    "jungle": {"combat": 0.30, "economy": 0.12, "objectives": 0.28, "vision": 0.12, "teamplay": 0.18},
    "support": {"combat": 0.25, "economy": 0.03, "objectives": 0.15, "vision": 0.30, "teamplay": 0.27},
    "unknown": {"combat": 0.30, "economy": 0.20, "objectives": 0.20, "vision": 0.15, "teamplay": 0.15},
}
# The metrics that a component is the mean of.
COMPONENTS = {
    "combat": ("kill_participation", "kda", "damage_share", "damage_efficiency"),
    "economy": ("gold_per_minute", "cs_per_minute"),
    "objectives": ("objective_share", "turret_share"),
    "vision": ("vision_per_minute", "ward_actions_per_minute"),
    "teamplay": ("deaths_per_minute", "utility_per_minute", "kill_participation"),
}
LOWER_IS_BETTER = {"deaths_per_minute"}


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1) with nulls as 0, rounded to 9 digits so that equal ratios tie."""
    return F.round(F.coalesce(a, F.lit(0)) / F.greatest(F.coalesce(b, F.lit(0)).cast("double"), F.lit(1.0)), 9)


def midrank(value: str, group: list[str], lower_is_better: bool = False) -> Column:
    """Percentile of the mean rank among equals, 0 to 100 inside the group; 50 in a group of one."""
    rank = F.rank().over(Window.partitionBy(*group).orderBy(value)) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    p = F.when(n > 1, 100 * (rank + (equal - 1) / 2) / F.greatest(n - 1, F.lit(1))).otherwise(50.0)
    return 100 - p if lower_is_better else p


def team_totals(players: DataFrame, group: str = "game_id", team: str = "team_id") -> DataFrame:
    """Adds the team's kills and damages to each row."""
    w = Window.partitionBy(group, team)
    return players.withColumns({"team_kills": F.sum("kills").over(w), "team_damage": F.sum("damage_to_champions").over(w), "team_objectives": F.sum("damage_to_objectives").over(w), "team_turrets": F.sum("damage_to_turrets").over(w)})


def raw_rates(players: DataFrame, duration: str = "duration") -> DataFrame:
    """Adds the twelve rates; ``players`` has the team totals and the match length in seconds."""
    c = F.col
    minutes = F.greatest(c(duration) / 60.0, F.lit(1.0))
    return players.withColumns({
        "kill_participation": ratio(c("kills") + c("assists"), c("team_kills")),
        "kda": ratio(c("kills") + c("assists"), c("deaths")),
        "damage_share": ratio(c("damage_to_champions"), c("team_damage")),
        "damage_efficiency": ratio(c("damage_to_champions"), c("gold_earned")),
        "gold_per_minute": ratio(c("gold_earned"), minutes),
        "cs_per_minute": ratio(c("cs"), minutes),
        "objective_share": ratio(c("damage_to_objectives"), c("team_objectives")),
        "turret_share": ratio(c("damage_to_turrets"), c("team_turrets")),
        "vision_per_minute": ratio(c("vision_score"), minutes),
        "ward_actions_per_minute": ratio(c("wards_placed") + c("wards_killed"), minutes),
        "deaths_per_minute": ratio(c("deaths"), minutes),
        "utility_per_minute": ratio(c("damage_mitigated") + c("healing"), minutes),
    })


def midrank_among(metric: str, rows: Column, inverted: bool = False) -> Column:
    """The same percentile from the group's rows at hand: 100 (below + (equal - 1) / 2) / (n - 1), 50 for one row."""
    below = F.size(F.filter(rows, lambda r: r[metric] < F.col(metric)))
    equal = F.size(F.filter(rows, lambda r: r[metric] == F.col(metric)))
    share = F.when(F.size(rows) > 1, 100 * (below + (equal - 1) / 2) / (F.size(rows) - 1)).otherwise(50.0)
    return 100 - share if inverted else share


def role_bucket(role: Column) -> Column:
    return F.when(role == "jungle", "jungle").when(role == "support", "support").when(role.isin("top", "mid", "bot"), "lane").otherwise("unknown")


def score_composite(players: DataFrame, group: str = "game_id", size: int = 10) -> DataFrame:
    """Adds five components, total_score and match_rank. Groups that do not have exactly ``size`` rows are left out.

    One shuffle by ``group``: the windows over (group) and (group, team) reuse it, and percentiles are taken inside each row
    over the ``size`` rows of its group, so no metric needs a sort.
    """
    full = players.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group))).where(F.col("__n") == size).drop("__n")
    rated = raw_rates(team_totals(full, group))
    metrics = sorted({m for ms in COMPONENTS.values() for m in ms})
    others = rated.withColumn("__all", F.collect_list(F.struct(*metrics)).over(Window.partitionBy(group)))
    ranked = others.withColumns({f"__{m}": midrank_among(m, F.col("__all"), m in LOWER_IS_BETTER) for m in metrics}).drop("__all")
    parts = ranked.withColumns({name: sum((F.col(f"__{m}") for m in ms), F.lit(0.0)) / len(ms) for name, ms in COMPONENTS.items()})
    bucket = role_bucket(F.col("role"))
    weighted = F.lit(0.0)
    for name in COMPONENTS:
        w = F.lit(WEIGHTS["unknown"][name])
        for b in ("lane", "jungle", "support"):
            w = F.when(bucket == b, WEIGHTS[b][name]).otherwise(w)
        weighted = weighted + F.col(name) * w
    scored = parts.withColumn("weighted", F.round(weighted, 9))
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 5 + F.col("weighted") * 0.9 + F.when(F.col("win"), 4.0).otherwise(0.0)))
    order = Window.partitionBy(group).orderBy(F.desc("total_score"), F.desc("weighted"), F.desc("damage_to_champions"), F.desc("kill_participation"), "participant_id")
    return scored.withColumn("total_score", F.round(total, 9)).withColumn("match_rank", F.row_number().over(order)).drop(*[f"__{m}" for m in metrics])


def observations(scored: DataFrame, group: str = "game_id", team: str = "team_id") -> DataFrame:
    """Adds up to four sentences about each participant: extreme components and unique leads."""
    g, t = Window.partitionBy(group), Window.partitionBy(group, team)
    names = list(COMPONENTS)
    top, low = F.greatest(*names), F.least(*names)
    first = lambda x: F.coalesce(*[F.when(F.col(n) == x, LABELS[n]) for n in names])
    spread = top - low >= 0.1
    found = [
        F.when(spread, F.concat(first(top), F.lit(" was the strongest component."))).otherwise("Score components were evenly balanced."),
        F.when(spread, F.concat(first(low), F.lit(" ranked lowest among the score components."))),
    ]
    flags = {}
    for key in LEADS:
        best = F.max(key).over(g)
        flags[f"__{key}"] = (F.col(key) > 0) & (F.col(key) == best)
    marked = scored.withColumns(flags | {"__kp": (F.col("team_kills") > 0) & (F.col("kill_participation") == F.max("kill_participation").over(t))})
    for key, text in LEADS.items():
        found.append(F.when(F.col(f"__{key}") & (F.sum(F.col(f"__{key}").cast("int")).over(g) == 1), text))
    found.append(F.when(F.col("__kp") & (F.sum(F.col("__kp").cast("int")).over(t) == 1), "Highest kill participation on the team."))
    return marked.withColumn("observations", F.slice(F.array_compact(F.array(*found)), 1, 4)).drop("__kp", *[f"__{k}" for k in LEADS])


# The words of the sentences.
LABELS = {"combat": "Combat", "economy": "Economy", "objectives": "Objectives", "vision": "Vision", "teamplay": "Survival/teamplay"}
LEADS = {"damage_to_champions": "Highest champion damage in the match.", "vision_score": "Highest vision score in the match.", "damage_to_objectives": "Highest objective damage in the match."}
