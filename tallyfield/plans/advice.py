"""Registered queries: advice for drafts and games, run lists and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import advice, draft, history
from tallyfield.plans.draft import _ATTR, _DIST, _MATCH, attributes
from tallyfield.plans.history import RUNS, runs
from tallyfield.sources import views
from tallyfield.sources.view_sql import PARTICIPANTS


@query(f"""with {PARTICIPANTS}, d as (select a.champion, b.champion partner, count(*) games, count(*) filter (a.win) * 100.0 / count(*) w from participants a join participants b on a.game_id = b.game_id and a.team_id = b.team_id and a.role = 'bot' and b.role = 'support' group by 1, 2),
u as (select 'bot' r, champion own, partner other, games, w from d union all select 'support', partner, champion, games, w from d), k as (select *, row_number() over (partition by own, r order by w desc, other) place from u where w between 44 and 60),
q as (select distinct cast(c_custkey % 25 as integer) champion, ['ADC', 'bot', 'Support', 'mid'][c_nationkey % 4 + 1] role_name from customer)
select q.champion, role_name as role, other partner, round(w, 9) win_rate, games, case when w >= 55 then 'S' when w >= 53 then 'A' when w >= 51 then 'B' else 'C' end tier, case when w >= 55 then 'Elite' when w >= 53 then 'Strong' when w >= 51 then 'Solid' else 'Playable' end || ' pairing' tier_label, cast(place as integer) place
from q join k on own = q.champion and r = case lower(role_name) when 'adc' then 'bot' else lower(role_name) end where place <= 5""")
def m29_p34_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    role = F.element_at(F.array(*[F.lit(x) for x in ("ADC", "bot", "Support", "mid")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    asked = c.select((F.col("c_custkey") % 25).cast("int").alias("champion"), role.alias("role")).distinct()
    return advice.partners(asked, draft.duos(views.participants(spark, sf_dir))).withColumn("win_rate", F.round("win_rate", 9))


@query(f"with {_MATCH} select champion, role, opponent, case when win_rate >= 52 then 'Favored' when win_rate >= 50 then 'Slightly Favored' when win_rate >= 48 then 'Even' when win_rate >= 46 then 'Slightly Unfavored' else 'Unfavored' end label from rates")
def p34_matchup_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft.matchups(views.participants(spark, sf_dir)).select("champion", "role", "opponent", advice.matchup_label(F.col("win_rate")).alias("label"))


_SIDES = f"""{_DIST}, {_ATTR}, comp as (select game_id, team_id, count(*) filter (damage_type = 'AD') ad, count(*) filter (damage_type = 'AP') ap, count(*) filter (damage_type = 'MIXED') mixed, count(*) filter (engage) eng, count(*) filter (cc like 'hard%') hcc, count(*) filter (cc = 'soft') scc, count(damage_type) known from participants left join attr using (champion) group by 1, 2),
sides as (select a.*, e.ad ead, e.ap eap, e.mixed emixed, e.eng eeng, e.hcc ehcc, e.known eknown from comp a join comp e on a.game_id = e.game_id and a.team_id <> e.team_id)"""
_RULES = [
    ("known >= 3 and eng = 0", "warn", "'No hard engage'", "engage"), ("known >= 3 and hcc = 0 and scc >= 2", "warn", "'Soft CC only, no lockdown'", "hard_cc"), ("known >= 3 and hcc = 0 and scc < 2", "warn", "'No hard CC'", "hard_cc"),
    ("known >= 3 and ap = 0 and mixed = 0 and ad >= 3", "warn", "'All AD, add magic dmg'", "ap"), ("known >= 3 and ad = 0 and mixed = 0 and ap >= 3", "warn", "'All AP, add AD threat'", "ad"),
    ("eknown >= 3 and eap = 0 and emixed = 0 and ead >= 3", "info", "'Enemy AD-heavy: buy armor'", ""), ("eknown >= 3 and ead = 0 and emixed = 0 and eap >= 3", "info", "'Enemy AP-heavy: buy MR'", ""),
    ("eknown >= 3 and eeng >= 2 and ehcc >= 3", "warn", "'Enemy wombo, disengage+peel'", ""), ("eknown >= 3 and eeng < 2 and ehcc >= 3", "info", "ehcc || ' hard CC: peel/tenacity'", ""), ("eknown >= 3 and eeng >= 2 and ehcc < 3", "info", "eeng || ' engage tools, disengage'", ""),
    ("eknown >= 3 and eeng = 0", "info", "'Enemy no engage, group free'", ""), ("known >= 3 and eng >= 2 and hcc >= 2", "good", "'Strong engage+CC, force it'", ""),
]


@query(f"""with {_SIDES}, obs as ({" union all ".join(f"select game_id, team_id, '{level}' as level, {short} short, nullif('{trait}', '') trait from sides where {rule}" for rule, level, short, trait in _RULES)}),
tr as (select champion, 'engage' trait from attr where engage union all select champion, 'hard_cc' from attr where cc like 'hard%' union all select champion, 'ap' from attr where damage_type in ('AP', 'MIXED') union all select champion, 'ad' from attr where damage_type in ('AD', 'MIXED')),
pool as (select t.trait, t.champion, round(d.pct, 9) pct from tr t join dist d using (champion) where d.role = 'mid' and d.pct >= 12), want as (select distinct game_id, trait from obs where trait is not null),
pick as (select w.game_id, w.trait, p.champion, row_number() over (partition by w.game_id, w.trait order by p.pct desc, p.champion) k from want w join pool p using (trait) where not exists (select 1 from participants x where x.game_id = w.game_id and x.champion = p.champion)),
ps as (select game_id, trait, string_agg(champion, ',' order by k) picks from pick where k <= 3 group by 1, 2)
select o.game_id, o.team_id, level, short, coalesce(picks, '') picks from obs o left join ps on ps.game_id = o.game_id and ps.trait = o.trait""")
def m27_draft_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every match; picks are sought for the middle role."""
    p, attr = views.participants(spark, sf_dir), attributes(spark, sf_dir)
    sides = advice.both_sides(draft.composition(p, attr, "game_id", "team_id"))
    said = advice.draft_observations(sides).select("game_id", "team_id", F.explode("observations").alias("o")).select("game_id", "team_id", "o.*")
    dist = draft.role_distribution(p).select("champion", "role", F.round("pct", 9).alias("pct"))
    asked = said.where("trait is not null").select(F.col("game_id").alias("draft"), F.lit("mid").alias("role"), "trait").distinct()
    found = draft.suggest_picks(asked, advice.trait_champions(attr), dist, p.select(F.col("game_id").alias("draft"), "champion").distinct())
    picks = found.groupBy(F.col("draft").alias("game_id"), "trait").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "champion"))), lambda x: x["champion"].cast("string")), ",").alias("picks"))
    return said.join(picks, ["game_id", "trait"], "left").select("game_id", "team_id", "level", "short", F.coalesce("picks", F.lit("")).alias("picks"))


_ITEMS = "items as (select p_partkey item_id, p_size * 60 gold, case when p_size % 3 = 0 then p_size else 0 end armor, case when p_size % 4 = 1 then p_size else 0 end mr, p_partkey % 7 = 0 consumable, p_partkey % 11 > 0 sr from part)"


@query(f"""with {PARTICIPANTS}, {_ATTR}, {_ITEMS}, fit as (select * from items where sr and gold >= 800 and not consumable), am as (select list(item_id order by armor desc, item_id)[1:3] l from fit where armor > 0), mm as (select list(item_id order by mr desc, item_id)[1:3] l from fit where mr > 0),
d as (select p.*, a.damage_type, a.cc, gold_earned // 10000 g from participants p join attr a using (champion)),
t as (select game_id, case when team_id = 100 then 200 else 100 end team_id, sum(case damage_type when 'AD' then 1000 + g when 'MIXED' then (1000 + g) / 2 else 0.0 end) ad, sum(case damage_type when 'AP' then 1000 + g when 'MIXED' then (1000 + g) / 2 else 0.0 end) ap, count(*) filter (cc like 'hard%') hard_cc, arg_max(champion, (g, -participant_id)) c, arg_max(damage_type, (g, -participant_id)) k, max(g) g from d group by 1, 2),
s as (select *, ad / (ad + ap) x, case when ad / (ad + ap) >= 0.68 then 'armor' when 1 - ad / (ad + ap) >= 0.68 then 'mr' else 'mixed' end primary_kind from t)
select game_id, team_id, primary_kind as "primary", round(x, 9) physical_share, hard_cc, c threat, g threat_gold, case when primary_kind <> 'mr' then array_to_string(am.l, ',') else '' end armor_items, case when primary_kind <> 'armor' then array_to_string(mm.l, ',') else '' end mr_items,
concat_ws('; ', case when hard_cc >= 3 then hard_cc || ' hard-CC threats' end, case when g >= 4000 then c || ' is the biggest item threat (' || case k when 'AD' then 'physical' when 'AP' then 'magic' else 'mixed' end || ')' end) notes from s, am, mm""")
def m28_item_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items."""
    size = F.col("p_size")
    items = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (size * 60).alias("gold"), F.when(size % 3 == 0, size).otherwise(0).alias("armor"), F.when(size % 4 == 1, size).otherwise(0).alias("mr"), F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("Consumable"))).otherwise(F.array().cast("array<string>")).alias("tags"), (F.col("p_partkey") % 11 > 0).alias("sr"))
    p = views.participants(spark, sf_dir).select("game_id", "participant_id", "team_id", "champion", F.floor(F.col("gold_earned") / 10000).alias("gold"))
    told = advice.item_advice(p, attributes(spark, sf_dir), items)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return told.withColumns({"armor_items": text("armor_items"), "mr_items": text("mr_items"), "notes": F.array_join("notes", "; "), "physical_share": F.round("physical_share", 9)})


@query(f"""with {RUNS}, o as (select *, row_number() over (partition by game_id order by case tier when 'aggregate' then 0 when 'live_client' then 1 when 'lcu_timeline' then 2 when 'match_v5' then 3 else -2 end desc, model_version desc, created_at desc, run_id desc) r from runs), a as (select game_id, run_id act from o where r = 1)
select game_id, run_id, tier, run_id = act is_active, cast(row_number() over (partition by game_id order by created_at desc, run_id desc) as integer) place from runs join a using (game_id)""")
def j7_run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return history.run_list(r, history.active_runs(r)).select("game_id", "run_id", "tier", "is_active", "place")


@query(f"""with {PARTICIPANTS}, g as (select game_id, 1::bigint model_version, count(*) participants, string_agg(participant_id || ':' || gold_earned || ':' || (kills % 10 + 1), ',' order by participant_id) t from participants where game_id % 4 > 0 group by 1)
select game_id, sha256(game_id || '|' || model_version || '|' || t) run_id, model_version, participants, 1 backfill from g""")
def m31_legacy_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth game has an active run. A second backfill, after the first has been activated, adds nothing."""
    p = views.participants(spark, sf_dir)
    scores = p.select("game_id", "participant_id", F.lit(1).cast("long").alias("model_version"), F.col("gold_earned").alias("total_score"), (F.col("kills") % 10 + 1).alias("match_rank"))
    active = p.where("game_id % 4 = 0").select("game_id").distinct()
    first = history.legacy_runs(scores, active)
    second = history.legacy_runs(scores, active.unionByName(first.select("game_id")))
    return first.withColumn("backfill", F.lit(1)).unionByName(second.withColumn("backfill", F.lit(2)))


@query(f"""with {_DIST}, fresh as (select champion, role, case when champion % 2 = 0 then pct / 100 else pct end * case when champion % 5 = 0 then 1.5 else 1.0 end pct from dist where champion % 3 > 0), peak as (select *, max(pct) over (partition by champion) m from fresh),
scaled as (select champion, role, case when m <= 1.5 then round(pct * 100, 2) else pct end pct from peak), good as (select champion from scaled group by 1 having sum(pct) between 50 and 130 and count(*) filter (pct >= 90) < 2)
select champion, role, round(pct, 6) pct from scaled where champion in (select champion from good) union all select champion, role, round(pct, 6) from dist where champion not in (select champion from good)""")
def m30_refreshed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh weights of two thirds of the champions, some as fractions, some beyond what is plausible."""
    dist = draft.role_distribution(views.participants(spark, sf_dir)).select("champion", "role", "pct")
    c = F.col("champion")
    fresh = dist.where(c % 3 > 0).withColumn("pct", F.when(c % 2 == 0, F.col("pct") / 100).otherwise(F.col("pct")) * F.when(c % 5 == 0, 1.5).otherwise(1.0))
    return advice.refreshed_weights(fresh, dist).withColumn("pct", F.round("pct", 6))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft sessions of the matches: positions by role, some blank; picks by cell, some only hovered."""
    p = views.participants(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for pos, role in advice.POSITIONS.items() for x in (role, pos)])
    position = F.when(F.col("kills") % 9 == 0, "").otherwise(F.element_at(names, F.col("role")))
    mate = F.struct("participant_id", F.when(F.col("puuid") % 11 > 0, F.col("puuid").cast("string")).otherwise("").alias("puuid"), position.alias("position"))
    action = F.struct("participant_id", (F.col("deaths") % 3 > 0).alias("completed"), F.col("champion").cast("long").alias("champion_id"))
    g = p.groupBy("game_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("team_id") == t, mate))).alias(n) for t, n in ((100, "one"), (200, "two"))], F.array_sort(F.collect_list(F.when(F.col("team_id") == 100, action))).alias("acts"))
    player = lambda c: F.transform(c, lambda x: F.named_struct(F.lit("puuid"), x["puuid"], F.lit("position"), x["position"]))
    cells = F.transform("one", lambda x: F.named_struct(F.lit("cell"), x["participant_id"], F.lit("position"), x["position"]))
    act = F.transform("acts", lambda x: F.array(F.named_struct(F.lit("cell"), x["participant_id"], F.lit("type"), F.lit("ban"), F.lit("completed"), F.lit(True), F.lit("champion_id"), F.lit(99).cast("long")), F.named_struct(F.lit("cell"), x["participant_id"], F.lit("type"), F.lit("pick"), F.lit("completed"), x["completed"], F.lit("champion_id"), x["champion_id"])))
    role = F.element_at(F.array(F.lit("bot"), F.lit("support"), F.lit("mid")), (F.col("game_id") % 3 + 1).cast("int"))
    return g.select("game_id", player("one").alias("team_one"), player("two").alias("team_two"), role.alias("my_role"), cells.alias("my_team"), act.alias("actions"))


@query(f"with {PARTICIPANTS} select game_id, cast(puuid as varchar) puuid, role from participants where kills % 9 > 0 and puuid % 11 > 0")
def p41_assigned_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.assigned_positions(sessions(spark, sf_dir))


@query(f"""with {PARTICIPANTS}, g as (select distinct game_id, case game_id % 3 when 0 then 'support' when 1 then 'bot' end other from participants)
select g.game_id, p.champion::bigint partner, case when p.champion is not null then other end partner_role from g left join participants p on p.game_id = g.game_id and p.team_id = 100 and p.role = other and kills % 9 > 0 and deaths % 3 > 0 and champion > 0""")
def p42_locked_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.locked_partner(sessions(spark, sf_dir)).select("game_id", "partner", "partner_role")
