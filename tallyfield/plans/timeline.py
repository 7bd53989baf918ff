"""Registered queries: features from timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import timeline as tl
from tallyfield.sources import views
from tallyfield.sources.view_sql import EVENTS, FRAMES

_TEAM = lambda c: f"(case when {c} <= 5 then 100 else 200 end)"
_PHASE = "case when t_ms < 840000 then 'early' when t_ms < 1500000 then 'mid' else 'late' end"
_PARTS = f"""{EVENTS}, parts as (select game_id, event_id, t_ms, kind, x, y, {_PHASE} as phase, killer, victim, unnest([killer, victim, assist]) participant_id, unnest(['killer', 'victim', 'assist']) part from timeline),
inv as (select * from parts where participant_id is not null and (part <> 'victim' or kind = 'champion_kill'))"""
_TRADES = f"""kills as (select * from timeline where kind = 'champion_kill'),
near as (select l.game_id, l.event_id, max(case when sqrt(cast((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) as double)) <= 3000 then 1 else 0 end) close
  from kills l join kills r on l.game_id = r.game_id and l.event_id <> r.event_id and r.t_ms between l.t_ms - 10000 and l.t_ms + 10000 and {_TEAM("r.killer")} = {_TEAM("l.victim")} group by 1, 2),
trades as (select k.game_id, k.event_id, k.victim, k.t_ms, case when n.close = 1 then 'traded' else 'untraded' end trade from kills k left join near n using (game_id, event_id))"""


@query(f"with {EVENTS}, {_TRADES} select game_id, event_id, cast(victim as integer) victim, trade from trades")
def j10_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.trades(views.timeline_events(spark, sf_dir)).select("game_id", "event_id", "victim", "trade")


def _fight(keys: str, phase: str) -> str:
    team = f"team as (select game_id, {phase}{_TEAM('participant_id')} team, count(*) n from inv where kind = 'champion_kill' and part = 'killer' group by all)"
    using = "game_id, " + phase + "team"
    return f"""with {_PARTS}, {_TRADES},
base as (select {keys}, {_TEAM("participant_id")} team, count(*) filter (part = 'killer') kill_events, count(*) filter (part = 'victim') death_events, count(*) filter (part = 'assist') assist_events from inv where kind = 'champion_kill' group by all),
dead as (select game_id, victim participant_id, {_PHASE} as phase, trade from trades),
d as (select {keys}, count(*) filter (trade = 'traded') a, count(*) filter (trade = 'untraded') b from dead group by all), {team}
select {keys}, kill_events, death_events, assist_events, coalesce(a, 0) traded_deaths, coalesce(b, 0) untraded_deaths, 0 unknown_deaths, round((kill_events + assist_events) / n, 6) event_kill_participation
from base left join d using ({keys}) left join team using ({using})"""


@query(_fight("game_id, participant_id", ""))
def a7_fight_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.fight_influence(views.timeline_events(spark, sf_dir))


@query(_fight("game_id, participant_id, phase", "phase, "))
def a14_phase_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.fight_influence(views.timeline_events(spark, sf_dir), by_phase=True)


@query(f"with {EVENTS} select game_id, cast(arg_min(killer, event_id + t_ms * 100000000) as integer) killer from timeline where kind = 'champion_kill' group by game_id")
def w3_first_blood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.first_blood(views.timeline_events(spark, sf_dir))


@query(f"""with {_PARTS}, c as (select * from inv where kind = 'elite_monster_kill'), f as (select * from inv where kind = 'champion_kill'),
h as (select distinct c.game_id, c.participant_id, c.event_id from c join f on c.game_id = f.game_id and c.participant_id = f.participant_id and abs(c.t_ms - f.t_ms) <= 20000 and sqrt(cast((c.x - f.x) * (c.x - f.x) + (c.y - f.y) * (c.y - f.y) as double)) <= 3000),
n as (select game_id, participant_id, count(*) k from h group by all)
select c.game_id, c.participant_id, count(*) direct_contacts, count(*) filter (part = 'killer') secures, coalesce(max(k), 0) objective_fights from c left join n using (game_id, participant_id) group by 1, 2""")
def a8_j11_objective_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.objective_contests(views.timeline_events(spark, sf_dir))


@query(f"""with {EVENTS}, w as (select * from timeline where kind in ('ward_placed', 'ward_kill')), f as (select * from timeline where kind in ('champion_kill', 'elite_monster_kill', 'building_kill')),
u as (select distinct w.game_id, w.event_id from w join f on w.game_id = f.game_id and f.t_ms between w.t_ms and w.t_ms + 20000 and {_TEAM("w.killer")} = {_TEAM("f.killer")} and sqrt(cast((w.x - f.x) * (w.x - f.x) + (w.y - f.y) * (w.y - f.y) as double)) <= 3000),
m as (select w.*, u.event_id is not null useful from w left join u using (game_id, event_id))
select game_id, killer participant_id, count(*) filter (kind = 'ward_placed') wards_placed, count(*) filter (kind = 'ward_kill') wards_killed, count(*) filter (kind = 'ward_placed' and useful) actionable_wards, count(*) filter (kind = 'ward_kill' and useful) actionable_dewards, round(count(*) filter (useful) / count(*), 6) actionable_rate from m group by 1, 2""")
def a11_j12_vision_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.vision_influence(views.timeline_events(spark, sf_dir))


@query(f"""with {EVENTS}, d as (select *, t_ms - lag(t_ms) over (partition by game_id, victim order by t_ms, event_id) gap, {_PHASE} as phase from timeline where kind = 'champion_kill')
select game_id, victim participant_id, count(*) deaths, count(*) filter (phase = 'early') early, count(*) filter (phase = 'mid') mid, count(*) filter (phase = 'late') late, count(*) filter (gap <= 45000) rapid_pairs, min(gap) min_gap_ms from d group by 1, 2""")
def a12_death_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.death_tempo(views.timeline_events(spark, sf_dir))


@query(f"""with {_PARTS}, pressure as (select game_id, participant_id victim, count(*) p from inv where kind not in ('ward_placed', 'ward_kill') and part <> 'victim' group by 1, 2),
a as (select i.*, coalesce(p, 0) p from inv i left join pressure using (game_id, victim) where kind = 'champion_kill' and part <> 'victim')
select game_id, participant_id, count(*) filter (part = 'assist' and {_TEAM("killer")} = {_TEAM("participant_id")}) ally_assists, count(*) filter ({_TEAM("participant_id")} <> {_TEAM("victim")}) suppressions,
cast(sum(case when {_TEAM("participant_id")} <> {_TEAM("victim")} then p else 0 end) as bigint) suppression_weight from a group by 1, 2""")
def a10_enablement_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.enablement_suppression(views.timeline_events(spark, sf_dir))


@query(f"with {EVENTS}, {FRAMES} select game_id, participant_id, t_ms, cast(gold as bigint) gold, x, y from frames")
def p15_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir)


@query(f"""with {_PARTS}, {FRAMES}, leads as (select a.* from frames a join frames b on a.game_id = b.game_id and a.t_ms = b.t_ms and b.participant_id = case when a.participant_id <= 5 then a.participant_id + 5 else a.participant_id - 5 end where a.gold - b.gold > 30000),
h as (select distinct l.game_id, l.participant_id, l.t_ms from leads l join inv i on i.game_id = l.game_id and i.participant_id = l.participant_id and i.part <> 'victim' and i.kind in ('champion_kill', 'elite_monster_kill', 'building_kill') and i.t_ms > l.t_ms and i.t_ms <= l.t_ms + 60000)
select l.game_id, l.participant_id, count(*) lead_windows, count(h.t_ms) converted, round(count(h.t_ms) / count(*), 6) conversion_rate from leads l left join h using (game_id, participant_id, t_ms) group by 1, 2""")
def j14_j16_resource_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.resource_conversion(views.frames(spark, sf_dir), views.timeline_events(spark, sf_dir))


@query(f"""with {EVENTS}, {FRAMES}, f as (select *, {_TEAM("participant_id")} team from frames where x is not null),
n as (select a.game_id, a.participant_id, a.t_ms, min(sqrt(cast((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as double))) d from f a join f b on a.game_id = b.game_id and a.t_ms = b.t_ms and a.team = b.team and a.participant_id <> b.participant_id group by all)
select game_id, participant_id, count(*) samples, count(*) filter (d > 3000) isolated from n group by 1, 2""")
def j17_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.isolation(views.frames(spark, sf_dir))


@query(f"""with {EVENTS}, {FRAMES}, w as (select * from timeline where kind = 'ward_placed')
select w.game_id, w.event_id, (select arg_max(f.x, f.t_ms) from frames f where f.game_id = w.game_id and f.participant_id = w.killer and f.x is not null and f.t_ms <= w.t_ms and f.t_ms >= w.t_ms - 60000) frame_x from w""")
def j13_asof_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    wards = views.timeline_events(spark, sf_dir).where("kind = 'ward_placed'").withColumnRenamed("killer", "participant_id").select("game_id", "participant_id", "event_id", "t_ms")
    return tl.asof_join(wards, views.frames(spark, sf_dir), ["game_id", "participant_id"], "t_ms", "x", tl.FRAME_AGE_MS, "frame_x").select("game_id", "event_id", "frame_x")


@query(f"""with {_PARTS} select game_id, event_id, participant_id, t_ms, phase, case when part = 'victim' then -1 else 1 end as sign,
case when kind = 'champion_kill' then case part when 'victim' then 'death' when 'assist' then 'champion_kill_assist' else 'champion_kill' end when kind = 'elite_monster_kill' then case part when 'assist' then 'objective_assist' else 'objective_secure' end else case part when 'assist' then 'structure_assist' else 'structure_secure' end end metric
from inv where kind in ('champion_kill', 'elite_monster_kill', 'building_kill')""")
def u2_signed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.signed_evidence(views.timeline_events(spark, sf_dir))
