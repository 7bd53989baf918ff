"""Registered queries: comparison, expectations, evidence and coaching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import review
from tallyfield.operators import timeline as tl
from tallyfield.plans.corpus import COMPONENTS
from tallyfield.sources import views
from tallyfield.sources.view_sql import MATCHES, PARTICIPANTS
from tallyfield.plans.timeline import _PARTS

_MODELS = f"""{PARTICIPANTS}, {MATCHES}, one as (select game_id, participant_id, gold_earned // 100 score, row_number() over (partition by game_id order by gold_earned // 100 desc, participant_id) r from participants),
two as (select p.game_id, participant_id, damage_to_champions // 100 score, row_number() over (partition by p.game_id order by damage_to_champions // 100 desc, participant_id) r, duration < 600 abstain from participants p join matches using (game_id)),
cmp as (select a.game_id, a.participant_id, a.score s1, b.score s2, a.r r1, b.r r2, abstain from one a join two b using (game_id, participant_id))"""


def _model(df: DataFrame, value: str, abstain) -> DataFrame:
    from pyspark.sql import Window

    s = F.floor(F.col(value) / 100)
    return df.select("game_id", "participant_id", s.alias("score"), F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc(s), "participant_id")).alias("rank"), abstain.alias("abstain"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir).join(views.matches(spark, sf_dir).select("game_id", "duration"), "game_id")
    return review.compare_models(_model(p, "gold_earned", F.lit(False)), _model(p, "damage_to_champions", F.col("duration") < 600))


@query(f"with {_MODELS} select game_id, participant_id, s2 - s1 score_delta, cast(r2 - r1 as integer) rank_delta from cmp")
def j21_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("game_id", "participant_id", "score_delta", "rank_delta")


@query(f"""with {_MODELS} select count(*) compared, count(*) filter (not abstain) told, round(avg(abs(s2 - s1)) filter (not abstain), 6) mae, round(avg((r1 = r2)::int) filter (not abstain), 6) exact, round(avg((abs(r1 - r2) <= 1)::int) filter (not abstain), 6) within_one,
round(corr(s1, s2) filter (not abstain), 6) pearson, round(count(*) filter (not abstain) / count(*), 6) coverage from cmp""")
def a29_shadow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = review.shadow_summary(_compared(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("mae", "exact", "within_one", "pearson", "coverage")})


@query(f"""with {PARTICIPANTS}, {MATCHES}, s as (select game_id, participant_id subject, gold_earned score from participants), top as (select game_id, arg_max(subject, score * 100 + subject) top from s group by game_id),
parts as (select game_id case_id, game_id, unnest([1, 2, 3, 4]) part from matches),
v as (select c.case_id, case part when 1 then (select duration < 400 from matches m where m.game_id = c.game_id)
  when 2 then (select a.score - b.score >= 0 from s a join s b on a.game_id = b.game_id where a.game_id = c.game_id and a.subject = 1 and b.subject = 12 - c.case_id % 3)
  when 3 then (select t.top <> 2 from top t where t.game_id = c.game_id) else (select score <= 90000000 from s where s.game_id = c.game_id and s.subject = 3) end ok from parts c where part = 1 + case_id % 4 or part = 4)
select case_id, case when bool_or(ok = false) then false when bool_or(ok is null) then null else true end passed from v group by case_id""")
def m23_check_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir)
    m = views.matches(spark, sf_dir)
    scores = p.select("game_id", F.col("participant_id").alias("subject"), F.col("gold_earned").alias("score"))
    kinds = F.array(*[F.lit(x) for x in ("insufficient_evidence", "pairwise_minimum_gap", "must_not_rank_first_solely_on_metric", "must_not_exceed")])
    part = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("part")
    c = m.select(F.col("game_id").alias("case_id"), "game_id", part).where("part = 1 + case_id % 4 or part = 4")
    subject = F.when(F.col("part") == 3, 2).when(F.col("part") == 4, 3)
    cases = c.select("case_id", "part", "game_id", F.element_at(kinds, F.col("part")).alias("type"), F.when(F.col("part") == 2, 1).alias("winner"), F.when(F.col("part") == 2, (12 - F.col("case_id") % 3).cast("int")).alias("loser"), subject.alias("subject"), F.lit(0).alias("min_gap"), F.lit(90000000).alias("max_score"), F.lit(400).alias("threshold"))
    return review.check_expectations(cases, scores, m)


@query(f"""with {_PARTS}, e as (select game_id, event_id, participant_id, t_ms, case when part = 'victim' then -1 else 1 end as sign,
case when kind = 'champion_kill' then case part when 'victim' then 'death' when 'assist' then 'champion_kill_assist' else 'champion_kill' end when kind = 'elite_monster_kill' then case part when 'assist' then 'objective_assist' else 'objective_secure' end else case part when 'assist' then 'structure_assist' else 'structure_secure' end end metric
from inv where kind in ('champion_kill', 'elite_monster_kill', 'building_kill')),
r as (select *, row_number() over (partition by game_id, participant_id, sign order by case when sign > 0 then list_position(['objective_secure', 'structure_secure', 'champion_kill', 'objective_assist', 'structure_assist', 'champion_kill_assist'], metric) else 0 end, t_ms, event_id) k from e)
select game_id, participant_id, string_agg(lpad(cast(t_ms // 60000 as varchar), 2, '0') || ':' || lpad(cast(t_ms // 1000 % 60 as varchar), 2, '0') || ' ' || metric, ', ' order by t_ms, event_id) picks from r where k <= 2 group by 1, 2""")
def w12_evidence_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = review.evidence_picks(tl.signed_evidence(views.timeline_events(spark, sf_dir)))
    return picks.select("game_id", "participant_id", F.array_join("picks", ", ").alias("picks"))


@query(f"""with {PARTICIPANTS}, f as (select puuid, role, 0 o, 'low vision' p, vision_score < 12 h from participants where role = 'support' union all select puuid, role, 1, 'many deaths', deaths > kills from participants union all select puuid, role, 2, 'low gold', gold_earned < 10000000 from participants),
g as (select puuid, role, o, p, count(*) n, count(*) filter (h) k from f group by all having count(*) filter (h) >= 2 and count(*) filter (h) >= 0.5 * count(*)), b as (select *, row_number() over (partition by puuid, role order by o) r from g)
select puuid, role, p pattern, k hits, n games from b where r = 1""")
def m24_coaching_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("support", "low vision", F.col("vision_score") < 12), ("*", "many deaths", F.col("deaths") > F.col("kills")), ("*", "low gold", F.col("gold_earned") < 10000000)]
    return review.coaching_patterns(views.participants(spark, sf_dir), rules, at_least=2)


@query(f"""with {PARTICIPANTS}, {MATCHES}, s as (select game_id session_id, game_id % 30 * 60 + 60 t, role as position, team_id, participant_id, cs, kills, gold_earned from participants)
select a.session_id, a.position, a.participant_id player, b.participant_id enemy, a.cs - b.cs cs_delta, a.kills - b.kills level_delta, a.gold_earned - b.gold_earned gold_delta, round(a.cs / greatest(a.t / 60.0, 1.0), 6) cs_per_minute from s a join s b on a.session_id = b.session_id and a.position = b.position and a.team_id <> b.team_id""")
def t9_lane_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir)
    s = p.select(F.col("game_id").alias("session_id"), (F.col("game_id") % 30 * 60 + 60).alias("t"), F.col("role").alias("position"), F.col("team_id").alias("team"), F.col("participant_id").alias("player"), "cs", F.col("kills").alias("level"), F.col("gold_earned").alias("gold"))
    return review.lane_comparison(s).drop("t").withColumn("cs_per_minute", F.round("cs_per_minute", 6))


@query("""with h as (select o_orderkey // 10 game_id, o_orderkey % 10 + 1 participant_id, l_partkey from orders left join lineitem on l_orderkey = o_orderkey)
select game_id, participant_id, cast(sum(coalesce(cast(round(p_retailprice * 100) as bigint), 0)) as bigint) gold from h left join part on p_partkey = l_partkey group by 1, 2""")
def a35_invested_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("items"))
    p = views.table(spark, sf_dir, "orders").join(held, "o_orderkey", "left").select(F.floor(F.col("o_orderkey") / 10).cast("long").alias("game_id"), (F.col("o_orderkey") % 10 + 1).alias("participant_id"), "items")
    prices = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))
    return review.invested_gold(p, prices, "items", "game_id", "participant_id")


@query(f"""with recursive {COMPONENTS}, {MATCHES}, g as (select node // 2 game_id, component from comp where node % 2 = 0), n as (select component, max(creation) newest from g join matches using (game_id) group by 1),
o as (select component, (row_number() over (order by newest, component) - 1) / count(*) over () x from n) select game_id, component, case when x < 0.8 - 1e-9 then 'train' when x < 0.9 - 1e-9 then 'validation' else 'test' end split from g join o using (component)""")
def m12_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.player_edges(spark, sf_dir).join(views.matches(spark, sf_dir).select("game_id", "creation"), "game_id")
    return review.temporal_split(e, "game_id", "puuid", "creation")


@query(f"""with {PARTICIPANTS}, g as (select distinct game_id from participants), q as (select distinct o_orderkey // 10 + case when o_custkey % 40 = 0 then 500000 else 0 end game_id from orders where o_orderkey % 10 < 3),
s as (select game_id, case game_id % 4 when 0 then 'match_v5' when 1 then 'lcu_timeline' when 2 then 'aggregate' end source from g), n1 as (select game_id, count(*) n from participants where game_id % 11 <> 4 and not (game_id % 11 = 5 and participant_id = 3) group by 1),
n2 as (select game_id, count(*) n from participants where game_id % 11 <> 4 and not (game_id % 11 = 5 and participant_id = 3) and not (game_id % 11 = 6 and participant_id = 1) group by 1)
select q.game_id, s.source, case when g.game_id is null then 'error' when source is null then 'no_supported_evidence' when q.game_id % 7 = 3 then 'missing_feature_set' when n1.n is null then 'missing_v1_run' when n1.n <> 10 then 'invalid_v1_run' when coalesce(n2.n, 0) <> 10 then 'error' else 'scored' end status
from q left join g using (game_id) left join s on s.game_id = q.game_id left join n1 on n1.game_id = q.game_id left join n2 on n2.game_id = q.game_id""")
def m22_shadow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested games of which some are unknown; what a game lacks follows from its id."""
    k = F.col("game_id")
    p = views.participants(spark, sf_dir).select("game_id", "participant_id")
    o = views.table(spark, sf_dir, "orders").where("o_orderkey % 10 < 3")
    asked = o.select((F.floor(F.col("o_orderkey") / 10) + F.when(F.col("o_custkey") % 40 == 0, 500_000).otherwise(0)).cast("long").alias("game_id"))
    games = p.select("game_id").distinct()
    routed = games.where(k % 4 < 3).select("game_id", F.element_at(F.array(*[F.lit(x) for x in ("match_v5", "lcu_timeline", "aggregate")]), (k % 4 + 1).cast("int")).alias("source"))
    first = p.where("game_id % 11 != 4 and not (game_id % 11 = 5 and participant_id = 3)")
    return review.shadow_status(asked, games, routed, routed.where(k % 7 != 3), first, p.where("not (game_id % 11 = 6 and participant_id = 1)"))
