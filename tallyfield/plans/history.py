"""Registered queries: score history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import history
from tallyfield.plans.scoring import SCORED_SQL, scored
from tallyfield.sources import views
from tallyfield.sources.view_sql import MATCHES, PARTICIPANTS


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).join(views.matches(spark, sf_dir).select("game_id", "creation", "local_id", "queue"), "game_id")


ROWS = f"{SCORED_SQL}, hist as (select s.*, m.creation, m.local_id, m.queue from scored s join matches m using (game_id))"


@query(f"""with {ROWS}, n as (select *, row_number() over (partition by puuid order by creation desc, game_id desc, participant_id desc) r from hist)
select puuid, count(*) games, count(*) filter (win) wins, count(*) filter (r <= 20) recent_games, count(*) filter (r <= 20 and win) recent_wins, avg(cast(round(total_score * 1000) as bigint)) avg_score, min(cast(match_rank as integer)) best_rank, avg(match_rank) avg_rank from n group by puuid""")
def a1_a3_player_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in thousandths, so that means are exact."""
    return history.player_summary(rows(spark, sf_dir).withColumn("total_score", F.round(F.col("total_score") * 1000).cast("long")))


@query(f"with {PARTICIPANTS} select champion, count(*) games, count(*) filter (win) wins, round(count(*) filter (win) * 100.0 / count(*), 6) win_rate from participants group by champion")
def a2_win_rate_by_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.win_rate(views.participants(spark, sf_dir), "champion").withColumn("win_rate", F.round("win_rate", 6))


@query(f"with {PARTICIPANTS} select puuid, champion, role, count(*) games, count(*) filter (win) wins from participants group by grouping sets ((puuid), (puuid, champion), (puuid, role))")
def a4_rates_per_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.grouped_rates(views.participants(spark, sf_dir))


@query(f"""with {ROWS}, own as (select * from hist where participant_id = local_id),
j as (select o.game_id, o.creation, o.champion, o.role, o.win, cast(o.match_rank as integer) match_rank, cast(min(h.match_rank) as integer) best_mate, cast(max(h.match_rank) as integer) worst_mate
  from own o join hist h on h.game_id = o.game_id and h.team_id = o.team_id and h.participant_id <> o.participant_id group by all)
select * from j order by creation desc, game_id desc limit 100""")
def j5_k1_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_page(rows(spark, sf_dir), 0, 100)


@query(f"""with {ROWS} select game_id, participant_id, team_id, role, cast(match_rank as integer) match_rank,
cast(row_number() over (partition by game_id order by team_id, list_position(['top', 'jungle', 'mid', 'bot', 'support'], role), participant_id) as integer) place from hist""")
def j6_k4_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.run_report(rows(spark, sf_dir)).select("game_id", "participant_id", "team_id", "role", "match_rank", "place")


@query(f"""with {ROWS}, p as (select a.game_id, a.participant_id, b.total_score v, row_number() over (partition by a.game_id, a.participant_id order by b.creation desc, b.game_id desc, b.total_score desc) r
  from hist a join hist b on a.puuid = b.puuid and a.role = b.role and b.creation < a.creation and b.duration >= 600)
select h.game_id, h.participant_id, cast(count(p.v) as integer) n_previous, coalesce(round(sum(p.v), 4), 0) previous_sum from hist h left join p on p.game_id = h.game_id and p.participant_id = h.participant_id and p.r <= 5 group by h.game_id, h.participant_id""")
def j9_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = history.lookback(rows(spark, sf_dir), 5, eligible=F.col("duration") >= 600)
    return seen.select("game_id", "participant_id", F.size("previous").alias("n_previous"), F.round(F.aggregate("previous", F.lit(0.0), lambda a, x: a + x), 4).alias("previous_sum"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as score runs of a game: the tier by supplier, the version by line number."""
    line = views.table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(x) for x in ("aggregate", "live_client", "lcu_timeline", "match_v5", "other")])
    return line.select(F.floor(F.col("l_orderkey") / 10).cast("long").alias("game_id"), F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("tier"), F.col("l_linenumber").alias("model_version"), F.col("l_shipdate").alias("created_at"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("run_id"))


RUNS = """runs as (select l_orderkey // 10 game_id, ['aggregate', 'live_client', 'lcu_timeline', 'match_v5', 'other'][l_suppkey % 5 + 1] tier, l_linenumber model_version, l_shipdate created_at, cast(round(l_extendedprice * 100) as bigint) run_id from lineitem)"""


@query(f"""with {RUNS}, o as (select *, row_number() over (partition by game_id order by case tier when 'aggregate' then 0 when 'live_client' then 1 when 'lcu_timeline' then 2 when 'match_v5' then 3 else -2 end desc, model_version desc, created_at desc, run_id desc) r from runs)
select game_id, tier, model_version, run_id from o where r = 1""")
def w8_active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.active_runs(runs(spark, sf_dir)).select("game_id", "tier", "model_version", "run_id")


@query(f"with {RUNS}, o as (select *, row_number() over (partition by game_id, tier order by created_at desc, run_id desc) r from runs) select game_id, tier, run_id from o where r = 1")
def w5_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(runs(spark, sf_dir), ["game_id", "tier"], ["created_at", "run_id"]).select("game_id", "tier", "run_id")


@query(f"""with {RUNS}, a as (select game_id, count(*) n, max(created_at) m from runs where tier = 'other' group by game_id),
{MATCHES}, d as (select *, m + to_seconds([300, 900, 3600, 21600, 86400, 604800][least(n, 6)]) next_at from a)
select x.game_id, coalesce(d.n, 0) n_failures from matches x left join d using (game_id) where not exists (select 1 from runs where tier = 'match_v5' and model_version = 1 and runs.game_id = x.game_id) and (next_at is null or next_at <= timestamp '1999-06-01')""")
def j3_missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    failures = r.where("tier = 'other'").select("game_id", F.col("created_at").alias("at"))
    return history.missing_evidence(views.matches(spark, sf_dir), r.where("tier = 'match_v5' and model_version = 1"), failures, F.lit("1999-06-01").cast("timestamp_ntz")).select("game_id", "n_failures")


@query(f"with {RUNS} select game_id, count(*) n_failures, cast([300, 900, 3600, 21600, 86400, 604800][least(count(*), 6)] as integer) delay_seconds from runs where tier = 'other' group by game_id")
def a36_retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retry_state(runs(spark, sf_dir).where("tier = 'other'").select("game_id", F.col("created_at").alias("at"))).select("game_id", "n_failures", "delay_seconds")


@query(f"with {RUNS} select distinct game_id, run_id from runs where tier = 'match_v5' and not exists (select 1 from runs s where s.tier = 'aggregate' and s.game_id = runs.game_id and s.run_id = runs.run_id)")
def s8_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select("tier", "game_id", "run_id")
    return history.append_new(r.where("tier = 'aggregate'"), r.where("tier = 'match_v5'"), ["game_id", "run_id"]).select("game_id", "run_id")


@query(f"""with {RUNS}, o as (select *, row_number() over (partition by game_id order by created_at desc, (tier = 'match_v5') desc, run_id desc) r from runs where tier in ('aggregate', 'match_v5')),
m as (select game_id, tier, max(created_at) c from runs where tier in ('aggregate', 'match_v5') group by game_id, tier)
select game_id, arg_max(tier, (c, tier = 'match_v5')) tier, max(c) created_at from m group by game_id""")
def s9_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = history.latest(runs(spark, sf_dir), ["game_id", "tier"], ["created_at", "run_id"])
    return history.upsert(newest.where("tier = 'aggregate'"), newest.where("tier = 'match_v5'"), ["game_id"], "created_at").select("game_id", "tier", "created_at")


@query("""with a as (select o_orderkey // 10 g, list_sort(list(distinct o_orderkey % 10)) a from orders group by 1), b as (select l_orderkey // 10 g, list_sort(list(distinct l_orderkey % 10)) b from lineitem group by 1)
select a.g game_id from a join b using (g) where a = b""")
def p43_u5_same_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = lambda t, k: views.table(spark, sf_dir, t).select(F.floor(F.col(k) / 10).cast("long").alias("game_id"), (F.col(k) % 10).alias("participant_id"))
    return history.same_members(member("orders", "o_orderkey"), member("lineitem", "l_orderkey").distinct())


@query(f"""with {RUNS}, {MATCHES}, a as (select game_id, count(*) n, max(created_at) m from runs where tier = 'other' group by game_id), d as (select *, m + to_seconds([300, 900, 3600, 21600, 86400, 604800][least(n, 6)]) next_at from a)
select x.game_id, coalesce(d.n, 0) n_failures, not exists (select 1 from runs where tier = 'match_v5' and model_version = 1 and runs.game_id = x.game_id) and (next_at is null or next_at <= timestamp '1999-06-01') due from matches x left join d using (game_id)""")
def j4_fetch_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    failures = r.where("tier = 'other'").select("game_id", F.col("created_at").alias("at"))
    return history.fetch_due(views.matches(spark, sf_dir), r.where("tier = 'match_v5' and model_version = 1"), failures, F.lit("1999-06-01").cast("timestamp_ntz")).select("game_id", "n_failures", "due")


@query("""with a as (select distinct l_orderkey // 10 game_id, l_orderkey % 10 + 1 participant_id from lineitem where l_linenumber = 2), b as (select distinct l_orderkey // 10 game_id, l_orderkey % 10 + 1 participant_id from lineitem where l_linenumber = 3 or l_suppkey % 9 = 0)
select *, 'missing' problem from (select * from a except select * from b) union all select *, 'unknown' from (select * from b except select * from a)""")
def u4_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with a second line are required, those with a third or of some suppliers are there."""
    line = views.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_suppkey", F.floor(F.col("l_orderkey") / 10).cast("long").alias("game_id"), (F.col("l_orderkey") % 10 + 1).alias("participant_id"))
    return history.set_differences(line.where("l_linenumber = 2"), line.where("l_linenumber = 3 or l_suppkey % 9 = 0"), ["game_id", "participant_id"])
