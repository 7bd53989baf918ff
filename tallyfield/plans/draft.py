"""Registered queries: draft statistics and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import draft
from tallyfield.sources import views
from tallyfield.sources.view_sql import PARTICIPANTS

_MATCH = f"""{PARTICIPANTS}, mu as (select a.champion, a.role, b.champion opponent, count(*) games, count(*) filter (a.win) wins from participants a join participants b on a.game_id = b.game_id and a.role = b.role and a.team_id <> b.team_id group by all),
rates as (select *, wins * 100.0 / games win_rate from mu)"""
_DIST = f"""{PARTICIPANTS}, dist as (select champion, role, count(*) games, count(*) * 100.0 / sum(count(*)) over (partition by champion) pct from participants group by champion, role)"""


@query(f"with {_MATCH} select champion, role, opponent, games, wins, round(win_rate, 9) win_rate from rates")
def a38_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.matchups(views.participants(spark, sf_dir)).withColumn("win_rate", F.round("win_rate", 9))


@query(f"with {PARTICIPANTS} select a.champion, b.champion partner, count(*) games, count(*) filter (a.win) wins, round(count(*) filter (a.win) * 100.0 / count(*), 9) win_rate from participants a join participants b on a.game_id = b.game_id and a.team_id = b.team_id and a.role = 'bot' and b.role = 'support' group by 1, 2")
def a39_duos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.duos(views.participants(spark, sf_dir)).withColumn("win_rate", F.round("win_rate", 9))


@query(f"with {_DIST} select champion, role, games, round(pct, 9) pct from dist")
def a40_role_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.role_distribution(views.participants(spark, sf_dir)).withColumn("pct", F.round("pct", 9))


@query(f"with {_DIST}, o as (select *, row_number() over (partition by champion order by games desc, list_position(['top', 'jungle', 'mid', 'bot', 'support'], role)) r from dist) select champion, role, round(pct, 9) pct from o where r = 1")
def w14_primary_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.primary_role(draft.role_distribution(views.participants(spark, sf_dir))).withColumn("pct", F.round("pct", 9))


_CURATED = "curated as (select distinct cast(c_custkey % 25 as integer) champion, ['top', 'jungle', 'mid', 'bot', 'support'][c_nationkey % 5 + 1] as role, cast(c_custkey % 24 as integer) counter from customer)"


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") % 25).cast("int").alias("champion"), views.role_of(F.col("c_nationkey") + 1).alias("role"), (F.col("c_custkey") % 24).cast("int").alias("counter")).distinct().withColumn("rate", F.lit(60.5))


@query(f"""with {_MATCH}, {_CURATED}, m as (select coalesce(c.champion, r.champion) champion, coalesce(c.role, r.role) as role, coalesce(c.counter, r.opponent) counter, case when c.champion is not null then 60.5 else 100 - r.win_rate end rate
from rates r full join curated c on c.champion = r.champion and c.role = r.role and c.counter = r.opponent), o as (select *, row_number() over (partition by champion, role order by rate desc, counter) place from m where rate > 50 and rate <= 70)
select champion, role, counter, round(rate, 9) rate, cast(place as integer) place from o where place <= 5""")
def j23_u1_k3_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.counters(draft.matchups(views.participants(spark, sf_dir)), curated(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query(f"""with {_MATCH}, q as (select champion, opponent, role from (select distinct cast(c_custkey % 25 as integer) champion, cast(c_custkey % 23 as integer) opponent, ['top', 'jungle', 'mid', 'bot', 'support'][c_nationkey % 5 + 1] as role from customer)),
l as (select q.*, coalesce(a.win_rate, 100 - b.win_rate) w from q left join rates a on a.champion = q.champion and a.role = q.role and a.opponent = q.opponent left join rates b on b.champion = q.opponent and b.role = q.role and b.opponent = q.champion)
select champion, opponent, role, case when w between 25 and 75 then round(w, 9) end win_rate from l""")
def j24_p33_matchup_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    asked = c.select((F.col("c_custkey") % 25).cast("int").alias("champion"), (F.col("c_custkey") % 23).cast("int").alias("opponent"), views.role_of(F.col("c_nationkey") + 1).alias("role")).distinct()
    table = draft.matchups(views.participants(spark, sf_dir))
    return draft.matchup_lookup(asked, table).withColumn("win_rate", F.round("win_rate", 9))


@query(f"""with {_DIST}, known as (select * from dist where (champion + list_position(['top', 'jungle', 'mid', 'bot', 'support'], role)) % 3 > 0), q as (select distinct champion, role from participants),
o as (select q.*, s.role found_role, s.games, row_number() over (partition by q.champion, q.role order by (s.role = q.role) desc, s.games desc, s.role desc) r from q left join known s using (champion))
select champion, role, found_role, games from o where r = 1""")
def j25_j28_role_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir)
    order = F.array_position(F.array(*[F.lit(r) for r in draft.ROLES]), F.col("role"))
    some = draft.role_distribution(p).where((F.col("champion") + order) % 3 > 0).select("champion", "role", "games")
    return draft.role_fallback(p.select("champion", "role").distinct(), some, ["champion"], F.col("games"))


_ATTR = "attr as (select cast(p_partkey as integer) champion, ['AD', 'AP', 'MIXED'][p_size % 3 + 1] damage_type, ['none', 'soft', 'hard-single', 'hard-aoe'][p_size % 4 + 1] cc, p_size % 2 = 0 engage from part where p_partkey between 1 and 24)"


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 rows of the part table as champions."""
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_size") % len(names) + 1).cast("int"))
    part = views.table(spark, sf_dir, "part").where("p_partkey between 1 and 24")
    return part.select(F.col("p_partkey").cast("int").alias("champion"), pick(("AD", "AP", "MIXED")).alias("damage_type"), pick(("none", "soft", "hard-single", "hard-aoe")).alias("cc"), (F.col("p_size") % 2 == 0).alias("engage"))


@query(f"""with {PARTICIPANTS}, {_ATTR} select game_id, team_id, count(*) filter (damage_type = 'AD') ad, count(*) filter (damage_type = 'AP') ap, count(*) filter (damage_type = 'MIXED') mixed, count(*) filter (engage) engage,
count(*) filter (cc like 'hard%') hard_cc, count(*) filter (cc = 'soft') soft_cc, count(*) filter (damage_type is null) as unknown from participants left join attr using (champion) group by 1, 2""")
def a33_j27_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.composition(views.participants(spark, sf_dir), attributes(spark, sf_dir), "game_id", "team_id")


@query(f"""with {PARTICIPANTS}, {_ATTR}, t as (select game_id, case when team_id = 100 then 200 else 100 end team_id,
sum(case damage_type when 'AD' then 1000 + gold_earned when 'MIXED' then (1000 + gold_earned) / 2 else 0.0 end) physical, sum(case damage_type when 'AP' then 1000 + gold_earned when 'MIXED' then (1000 + gold_earned) / 2 else 0.0 end) magic from participants left join attr using (champion) group by 1, 2)
select game_id, team_id, physical, magic, case when physical / nullif(physical + magic, 0) >= 0.68 then 'armor' when physical / nullif(physical + magic, 0) <= 1 - 0.68 then 'mr' when physical + magic > 0 then 'mixed' end answer from t""")
def a34_m28_threat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.threat(views.participants(spark, sf_dir).withColumnRenamed("gold_earned", "gold"), attributes(spark, sf_dir))


@query(f"""with {_DIST}, w as (select champion, list(pct order by list_position(['top', 'jungle', 'mid', 'bot', 'support'], role)) w from (select c.champion, r.role, coalesce(d.pct, 0) pct from (select distinct champion from dist) c cross join (select unnest(['top', 'jungle', 'mid', 'bot', 'support']) as role) r left join dist d using (champion, role)) group by champion),
t as (select game_id, team_id, list(w order by participant_id) w from participants join w using (champion) group by 1, 2), p as (select a, b, c, d, e from range(5) a(a), range(5) b(b), range(5) c(c), range(5) d(d), range(5) e(e) where len(list_distinct([a, b, c, d, e])) = 5),
s as (select game_id, team_id, w[1][a + 1] + w[2][b + 1] + w[3][c + 1] + w[4][d + 1] + w[5][e + 1] total from t, p where w[1][a + 1] > 0 and w[2][b + 1] > 0 and w[3][c + 1] > 0 and w[4][d + 1] > 0 and w[5][e + 1] > 0)
select game_id, team_id, round(max(total), 6) weight from s group by 1, 2""")
def m25_m26_o1_assign_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir)
    share = draft.role_distribution(p).groupBy("champion").pivot("role", list(draft.ROLES)).agg(F.max("pct"))
    w = share.select("champion", F.array(*[F.coalesce(r, F.lit(0.0)) for r in draft.ROLES]).alias("w"))
    teams = p.join(F.broadcast(w), "champion").groupBy("game_id", "team_id").agg(F.array_sort(F.collect_list(F.struct("participant_id", "w"))).alias("ps")).select("game_id", "team_id", F.transform("ps", lambda x: x["w"]).alias("weights"))
    return draft.assign_roles(teams).select("game_id", "team_id", F.round("weight", 6).alias("weight"))


@query(f"""with {_DIST}, {_ATTR}, req as (select distinct game_id draft, role, 'AP' trait from participants), taken as (select distinct game_id draft, champion from participants),
f as (select r.*, d.champion, d.pct from req r join dist d using (role) join attr a on a.champion = d.champion and a.damage_type = r.trait where d.pct >= 12 and not exists (select 1 from taken t where t.draft = r.draft and t.champion = d.champion)),
o as (select *, row_number() over (partition by draft, role order by round(pct, 9) desc, champion) place from f) select draft, role, trait, champion, cast(place as integer) place from o where place <= 3""")
def k6_suggest_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir)
    asked = p.select(F.col("game_id").alias("draft"), "role", F.lit("AP").alias("trait")).distinct()
    champions = attributes(spark, sf_dir).select("champion", F.col("damage_type").alias("trait"))
    dist = draft.role_distribution(p).select("champion", "role", F.round("pct", 9).alias("pct"))
    return draft.suggest_picks(asked, champions, dist, p.select(F.col("game_id").alias("draft"), "champion").distinct())


@query("select distinct p_name from part where contains(lower(p_name), 'e') order by p_name limit 12")
def k7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.search(views.table(spark, sf_dir, "part").select("p_name").distinct(), "E", "p_name")
