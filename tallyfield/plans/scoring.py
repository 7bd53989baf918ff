"""Registered queries: composite scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import composite
from tallyfield.sources import views
from tallyfield.sources.view_sql import MATCHES, PARTICIPANTS

_RATES = {
    "kill_participation": ("kills + assists", "team_kills"), "kda": ("kills + assists", "deaths"), "damage_share": ("damage_to_champions", "team_damage"),
    "damage_efficiency": ("damage_to_champions", "gold_earned"), "gold_per_minute": ("gold_earned", "duration / 60.0"), "cs_per_minute": ("cs", "duration / 60.0"),
    "objective_share": ("damage_to_objectives", "team_objectives"), "turret_share": ("damage_to_turrets", "team_turrets"), "vision_per_minute": ("vision_score", "duration / 60.0"),
    "ward_actions_per_minute": ("wards_placed + wards_killed", "duration / 60.0"), "deaths_per_minute": ("deaths", "duration / 60.0"), "utility_per_minute": ("damage_mitigated + healing", "duration / 60.0"),
}


def _weights(name: str) -> str:
    w = composite.WEIGHTS
    return f"case role when 'jungle' then {w['jungle'][name]} when 'support' then {w['support'][name]} else {w['lane'][name]} end"


RATES_SQL = f"""{PARTICIPANTS}, {MATCHES},
totals as (select p.*, m.duration, sum(kills) over t team_kills, sum(damage_to_champions) over t team_damage, sum(damage_to_objectives) over t team_objectives, sum(damage_to_turrets) over t team_turrets
  from participants p join matches m using (game_id) window t as (partition by game_id, team_id)),
rates as (select *, {", ".join(f"round(({a}) / greatest(cast({b} as double), 1.0), 9) {n}" for n, (a, b) in _RATES.items())} from totals)"""

SCORED_SQL = f"""{RATES_SQL},
ranks as (select *, {", ".join(f"{'100 - ' if n in composite.LOWER_IS_BETTER else ''}100.0 * (rank() over (partition by game_id order by {n}) - 1 + (count(*) over (partition by game_id, {n}) - 1) / 2) / 9 p_{n}" for n in _RATES)} from rates),
parts as (select *, {", ".join(f"({' + '.join('p_' + m for m in ms)}) / {len(ms)} {name}" for name, ms in composite.COMPONENTS.items())} from ranks),
sums as (select *, round({" + ".join(f"{name} * {_weights(name)}" for name in composite.COMPONENTS)}, 9) weighted from parts),
totalled as (select *, round(least(100.0, greatest(0.0, 5 + weighted * 0.9 + case when win then 4.0 else 0.0 end)), 9) total_score from sums),
scored as (select *, row_number() over (partition by game_id order by total_score desc, weighted desc, damage_to_champions desc, kill_participation desc, participant_id) match_rank from totalled)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = views.participants(spark, sf_dir).join(views.matches(spark, sf_dir).select("game_id", "duration"), "game_id")
    return composite.score_composite(players)


@query(f"with {SCORED_SQL} select game_id, participant_id, {', '.join(f'round({c}, 5) {c}' for c in (*composite.COMPONENTS, 'total_score'))}, cast(match_rank as integer) match_rank from scored")
def m1_score_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("game_id", "participant_id", *[F.round(c, 5).alias(c) for c in (*composite.COMPONENTS, "total_score")], "match_rank")


@query(f"with {RATES_SQL} select game_id, participant_id, {', '.join(_RATES)} from rates")
def a6_raw_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = views.participants(spark, sf_dir).join(views.matches(spark, sf_dir).select("game_id", "duration"), "game_id")
    return composite.raw_rates(composite.team_totals(players)).select("game_id", "participant_id", *_RATES)


_NAMES = list(composite.COMPONENTS)
_FIRST = lambda x: "case " + " ".join(f"when {n} = {x} then '{composite.LABELS[n]}'" for n in _NAMES) + " end"


@query(f"""with {SCORED_SQL},
tops as (select *, greatest({", ".join(_NAMES)}) hi, least({", ".join(_NAMES)}) lo, {", ".join(f"{k} > 0 and {k} = max({k}) over g f_{k}" for k in composite.LEADS)},
  team_kills > 0 and kill_participation = max(kill_participation) over t f_kp from scored window g as (partition by game_id), t as (partition by game_id, team_id)),
uniq as (select *, {", ".join(f"f_{k} and sum(f_{k}::int) over (partition by game_id) = 1 u_{k}" for k in composite.LEADS)}, f_kp and sum(f_kp::int) over (partition by game_id, team_id) = 1 u_kp from tops)
select game_id, participant_id, array_to_string(list_filter([case when hi - lo >= 0.1 then {_FIRST("hi")} || ' was the strongest component.' else 'Score components were evenly balanced.' end,
  case when hi - lo >= 0.1 then {_FIRST("lo")} || ' ranked lowest among the score components.' end, {", ".join(f"case when u_{k} then '{t}' end" for k, t in composite.LEADS.items())},
  case when u_kp then 'Highest kill participation on the team.' end], lambda x: x is not null)[1:4], ' ') observations from uniq""")
def m2_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.observations(scored(spark, sf_dir)).select("game_id", "participant_id", F.array_join("observations", " ").alias("observations"))
