"""Registered queries: feature rows and what evidence they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import SQL, query
from tallyfield.operators import features as ft
from tallyfield.plans import timeline as plans
from tallyfield.sources import views
from tallyfield.sources.view_sql import EVENTS, FRAMES, MATCHES, PARTICIPANTS

_PHASE = plans._PHASE
# plates among the buildings, and positions that are missing
_DETAILED = f"""{EVENTS}, detailed as (select * replace (case when kind = 'building_kill' and event_id % 3 = 0 then 'turret_plate' else kind end as kind, case when event_id % 11 <> 0 then x end as x, case when event_id % 11 <> 0 then y end as y), {_PHASE} as phase from timeline)"""


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.timeline_events(spark, sf_dir)
    placed = F.col("event_id") % 11 != 0
    return e.withColumns({"kind": F.when((F.col("kind") == "building_kill") & (F.col("event_id") % 3 == 0), "turret_plate").otherwise(F.col("kind")), "x": F.when(placed, F.col("x")), "y": F.when(placed, F.col("y"))})


def _objectives(view: str, phase: str) -> str:
    """The eleven counts over a view of events with their phase."""
    keys = f"game_id, participant_id{phase}"
    same = "and c.phase = f.phase" if phase else ""
    return f"""acts as (select * from (select *, unnest([killer, assist]) participant_id, unnest(['killer', 'assist']) part from {view}) where participant_id is not null),
fights as (select * from (select *, unnest([killer, victim, assist]) participant_id from {view} where kind = 'champion_kill') where participant_id is not null),
near as (select c.game_id, c.participant_id, c.event_id, max(case when coalesce(sqrt(cast((c.x - f.x) * (c.x - f.x) + (c.y - f.y) * (c.y - f.y) as double)), 1e9) <= 3000 then 1 else 0 end) close, count(*) filter (c.x is null or f.x is null) unplaced
  from acts c join fights f on c.game_id = f.game_id and c.participant_id = f.participant_id and abs(c.t_ms - f.t_ms) <= 20000 {same} where c.kind = 'elite_monster_kill' group by all),
objectives as (select {keys},
  count(*) filter (monster_type = 'HORDE' and part = 'killer') grub_secures, count(*) filter (monster_type = 'HORDE' and part = 'assist') grub_assists,
  count(*) filter (monster_type <> 'HORDE' and part = 'killer') epic_monster_secures, count(*) filter (monster_type <> 'HORDE' and part = 'assist') epic_monster_assists,
  count(*) filter (kind = 'building_kill' and building_type = 'TOWER_BUILDING' and part = 'killer') turret_kills, count(*) filter (kind = 'building_kill' and building_type = 'TOWER_BUILDING' and part = 'assist') turret_assists,
  count(*) filter (kind = 'building_kill' and building_type = 'INHIBITOR_BUILDING' and part = 'killer') inhibitor_kills, count(*) filter (kind = 'turret_plate' and part = 'killer') turret_plates,
  count(*) filter (kind = 'elite_monster_kill' and close = 1) objective_fight_involvements, count(*) filter (kind = 'elite_monster_kill' and close = 0 and unplaced > 0) unknown_objective_contest_context, count(*) filter (kind = 'elite_monster_kill') direct_objective_contacts
  from acts left join near using (game_id, participant_id, event_id) where kind in ('elite_monster_kill', 'building_kill', 'turret_plate') group by all)"""


@query(f"with {_DETAILED}, {_objectives('detailed', '')} select * from objectives")
def a8_objective_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.objective_participation(detailed(spark, sf_dir))


_LANES = "lanes as (select game_id, participant_id, string_agg(distinct lane, ',' order by lane) lanes_pressured from acts where kind in ('building_kill', 'turret_plate') and lane is not null group by all)"
_ALONE = f"alone as ({SQL['j17_isolation']})"


@query(f"""with {_DETAILED}, {_objectives('detailed', '')}, {_LANES}, {_ALONE}
select game_id, participant_id, coalesce(turret_kills + inhibitor_kills, 0) structure_secures, coalesce(turret_assists, 0) structure_assists, coalesce(turret_plates, 0) turret_plates, coalesce(lanes_pressured, '') lanes_pressured, coalesce(isolated, 0) isolated_frame_samples
from objectives full join lanes using (game_id, participant_id) full join alone using (game_id, participant_id)""")
def a9_structure_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.structure_pressure(detailed(spark, sf_dir), views.frames(spark, sf_dir)).withColumn("lanes_pressured", F.array_join("lanes_pressured", ","))


def live_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views as samples of the acting player's state."""
    e = views.timeline_events(spark, sf_dir).where("kind in ('ward_placed', 'ward_kill')")
    k = F.col("event_id")
    return e.select("game_id", F.col("killer").alias("participant_id"), F.struct("t_ms", "event_id").alias("t_ms"), (k % 18 + 1).alias("level"), (k % 13).alias("kills"), (k % 7).alias("deaths"), (k % 11).alias("assists"), (k % 200).alias("cs"), (k % 6).alias("item_count"), (k % 9 == 0).alias("is_dead"), F.when(k % 9 == 0, (k % 60).cast("double")).alias("respawn_timer"))


_LIVE = """live as (select game_id, killer participant_id, count(*) observed_samples, arg_max(event_id, event_id + t_ms * 100000000) k, round(count(*) filter (event_id % 9 = 0) / count(*), 4) dead_sample_rate, max(case when event_id % 9 = 0 then cast(event_id % 60 as double) end) max_respawn_timer
from timeline where kind in ('ward_placed', 'ward_kill') group by all)"""


@query(f"with {EVENTS}, {_LIVE} select game_id, participant_id, observed_samples, k % 18 + 1 final_level, k % 13 final_kills, k % 7 final_deaths, k % 11 final_assists, k % 200 final_cs, k % 6 final_item_count, dead_sample_rate, max_respawn_timer from live")
def a13_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.live_state(live_samples(spark, sf_dir))


_COUNTS = ("kill_events", "death_events", "assist_events", "traded_deaths", "untraded_deaths", "unknown_deaths")
_ROSTER = "roster as (select g.game_id, cast(p.participant_id as integer) participant_id from (select distinct game_id from timeline) g, range(1, 11) p(participant_id))"
_BLOOD = f"blood as (select game_id, arg_min(killer, event_id + t_ms * 100000000) participant_id, {_PHASE.replace('t_ms', 'min(t_ms)')} as phase from timeline where kind = 'champion_kill' group by game_id)"


@query(f"""with {EVENTS}, phased as (select *, {_PHASE} as phase from timeline), {_objectives('phased', ', phase')}, {_ROSTER}, {_BLOOD}, fight as ({SQL['a14_phase_breakdown']})
select r.game_id, r.participant_id, p.phase, {", ".join(f"coalesce({c}, 0) {c}" for c in (*_COUNTS, *ft.OBJECTIVES))}, b.game_id is not null first_blood
from roster r cross join (select unnest(['early', 'mid', 'late']) phase) p left join fight f on f.game_id = r.game_id and f.participant_id = r.participant_id and f.phase = p.phase
left join objectives o on o.game_id = r.game_id and o.participant_id = r.participant_id and o.phase = p.phase left join blood b on b.game_id = r.game_id and b.participant_id = r.participant_id and b.phase = p.phase""")
def a14_phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.phase_breakdown(views.timeline_events(spark, sf_dir))


@query(f"""with {EVENTS}, {FRAMES}, e as (select game_id, count(*) events, count(distinct killer) filter (kind in ('ward_placed', 'ward_kill')) live_participants from timeline group by 1), f as (select game_id, count(distinct participant_id) framed_participants from frames group by 1)
select game_id, events, framed_participants, live_participants from e join f using (game_id)""")
def a15_evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.evidence_counts(views.timeline_events(spark, sf_dir), views.frames(spark, sf_dir), live_samples(spark, sf_dir))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of all matches with events; the composite's participants are their raw counts."""
    raw = views.participants(spark, sf_dir).select("game_id", "participant_id", "kills", "deaths", "assists")
    return ft.extract_features(views.timeline_events(spark, sf_dir), views.frames(spark, sf_dir), live_samples(spark, sf_dir), raw)


_FLAT = {f"{n}_{c}": f"{n}.{c}" for n, (counts, values) in ft.FAMILIES.items() for c in (*counts, *values) if c != "lanes_pressured"}
_SOURCES = {"fight_influence": "fight", "objective_participation": "objectives", "structure_pressure": "structure", "enablement_suppression": "enable", "vision_influence": "vision", "death_tempo": "tempo", "resource_conversion": "conversion", "live_state": "liv"}
_USING = "using (game_id, participant_id)"
_ROWS = f"""{PARTICIPANTS}, {EVENTS}, phased as (select *, {_PHASE} as phase from timeline), {_objectives('phased', '')}, {_ROSTER}, {_BLOOD}, {_LIVE}, {_ALONE}, {_LANES},
fight as (select f.*, b.game_id is not null first_blood from ({SQL['a7_fight_influence']}) f left join blood b {_USING}), structure as (select game_id, participant_id, turret_kills + inhibitor_kills structure_secures, turret_assists structure_assists, turret_plates, isolated isolated_frame_samples, lanes_pressured from roster left join objectives {_USING} left join alone {_USING} left join lanes {_USING}),
enable as ({SQL['a10_enablement_suppression']}), vision as ({SQL['a11_j12_vision_influence']}), tempo as ({SQL['a12_death_tempo']}), conversion as ({SQL['j14_j16_resource_conversion']}), liv as (select *, k % 18 + 1 final_level, k % 13 final_kills from live),
made as (select game_id, participant_id, raw.kills raw_kills, raw.deaths raw_deaths, raw.assists raw_assists, coalesce(lanes_pressured, '') lanes_pressured,
{", ".join([f"coalesce({_SOURCES[n]}.{c}, 0) {n}_{c}" for n, (counts, _) in ft.FAMILIES.items() for c in counts] + [(f"coalesce({_SOURCES[n]}.{c}, false)" if c == "first_blood" else f"{_SOURCES[n]}.{c}") + f" {n}_{c}" for n, (_, values) in ft.FAMILIES.items() for c in values if c != "lanes_pressured"])}
from roster left join participants raw {_USING} {" ".join(f"left join {t} {_USING}" for t in _SOURCES.values())})"""


@query(f"with {_ROWS} select * from made")
def m3_extract_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structs of a row side by side."""
    flat = [F.col(path).alias(name) for name, path in _FLAT.items()]
    return rows(spark, sf_dir).select("game_id", "participant_id", *[F.col(f"raw.{c}").alias(f"raw_{c}") for c in ("kills", "deaths", "assists")], F.array_join("structure_pressure.lanes_pressured", ",").alias("lanes_pressured"), *flat)


def _value(f: ft.Feature) -> str:
    x = f"cast({f.path.replace('.', '_')} as double)"
    return (f"case when {x} is not null then ln(1 + greatest({x}, 0)) end" if f.transform == "log1p" else f"case when {x} is not null then least(greatest({x}, 0), 1) end" if f.transform == "clamp01" else x) + f" {f.name}"


@query(f"with {_ROWS}, v as (select game_id, participant_id, {', '.join(map(_value, ft.contract('match_v5')))} from made) select game_id, participant_id, {', '.join(f'round({f.name}, 9) {f.name}' for f in ft.contract('match_v5'))} from v")
def p24_p25_model_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ft.contract("match_v5")
    return ft.model_values(rows(spark, sf_dir), wanted).select("game_id", "participant_id", *[F.round(f.name, 9).alias(f.name) for f in wanted])


_STATUS = "['completed', 'partial_silence', 'active', 'partial_empty']"


@query(f"""with {MATCHES}, t as (select game_id, 'match_v5' tier, (game_id % 5) / 4 c from matches where game_id % 2 = 0 union all select game_id, 'lcu_timeline', (game_id % 4) / 3 from matches where game_id % 3 = 0),
s as (select o_orderkey // 10 game_id, o_orderkey session_id, {_STATUS}[o_orderkey % 4 + 1] status, (o_custkey % 11) / 10 c, cast(o_orderdate as varchar) u from orders),
live as (select game_id, arg_max(session_id, (c, u, session_id)) session_id, max(c) c from s where (status = 'completed' or status like 'partial#_%' escape '#') and c > 0 group by 1),
e as (select game_id, tier, c from t where c > 0 union all select game_id, 'live_client', c from live union all select game_id, 'aggregate', 1.0 from matches),
b as (select game_id, arg_max(tier, (case when tier = 'aggregate' then -1 else c end, case tier when 'match_v5' then 0 when 'lcu_timeline' then -1 when 'live_client' then -2 else -3 end)) best_tier from e group by 1)
select game_id, coalesce(max(c) filter (tier = 'match_v5'), 0) match_v5, coalesce(max(c) filter (tier = 'lcu_timeline'), 0) lcu_timeline, coalesce(max(c) filter (tier = 'live_client'), 0) live_client, 1.0::double aggregate, any_value(best_tier) best_tier from e join b using (game_id) group by game_id""")
def m4_w6_w7_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tiers a game has is derived from its id; its orders are its live sessions."""
    g = views.matches(spark, sf_dir).select("game_id")
    k = F.col("game_id")
    timelines = g.where(k % 2 == 0).select("game_id", F.lit("match_v5").alias("tier"), (k % 5 / 4).alias("completeness")).unionByName(g.where(k % 3 == 0).select("game_id", F.lit("lcu_timeline").alias("tier"), (k % 4 / 3).alias("completeness")))
    o = views.table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*[F.lit(x) for x in ("completed", "partial_silence", "active", "partial_empty")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    sessions = o.select(F.floor(F.col("o_orderkey") / 10).cast("long").alias("game_id"), F.col("o_orderkey").alias("session_id"), status.alias("status"), (F.col("o_custkey") % 11 / 10).alias("completeness"), F.col("o_orderdate").cast("string").alias("updated_at"))
    return ft.capabilities(g, timelines, sessions)
