"""Registered queries: roles of unfinished drafts, nested expectations and their library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import expectations, roles
from tallyfield.sources import views
from tallyfield.sources.view_sql import MATCHES, PARTICIPANTS


def role_weights(champion: Column) -> Column:
    """Weights of a champion by role: one main role and two others; every fourth is spread, one is unknown."""
    k = [F.pmod(F.lit(r) - champion, F.lit(5)) for r in range(5)]
    spread = F.array(*[F.when(x == 0, 45.0).when(x == 1, 32.0).when(x == 3, 12.0).otherwise(0.0) for x in k])
    narrow = F.array(*[F.when(x == 0, 70.0 + champion).when(x == 1, F.greatest(F.lit(0.0), 25.0 - champion)).when(x == 2, 4.0).otherwise(0.0) for x in k])
    return F.when(champion == 11, F.lit(None)).when(champion % 4 == 3, spread).otherwise(narrow)


_W = """case when champion % 4 = 3 then case (ri - champion % 5 + 5) % 5 when 0 then 45.0 when 1 then 32.0 when 3 then 12.0 else 0.0 end
else case (ri - champion % 5 + 5) % 5 when 0 then 70.0 + champion when 1 then greatest(0.0, 25.0 - champion) when 2 then 4.0 else 0.0 end end"""
_FILL = "\n".join(
    f"""f{r + 1} as (select * replace (case when seats[{r + 1}] is null then list_concat(list_concat(seats[1:{r}], [list_reverse_sort(list_transform(list_filter(ks, lambda x: not list_contains(seats, x.n) and x.w[{r + 1}] >= 10), lambda x: {{'w': x.w[{r + 1}], 'n': x.n}}))[1].n]), seats[{r + 2}:5]) else seats end as seats) from f{r}),"""
    for r in range(5)
)


@query(f"""with recursive {PARTICIPANTS}, picks as (select game_id, team_id, champion, 'C' || champion n, min(participant_id) pos from participants where (participant_id - 1) % 5 < 3 + game_id % 3 group by 1, 2, 3),
w as (select *, {_W} pct from picks, range(5) r(ri) where champion <> 11),
best as (select game_id, team_id, n, pos, max(pct) pct, arg_max(ri, (pct, -ri)) ri from w group by 1, 2, 3, 4),
claimed as (select game_id, team_id, ri, arg_max(n, (pct, -pos)) n from best where pct >= 85 group by 1, 2, 3),
rest as (select game_id, team_id, n, row_number() over (partition by game_id, team_id order by n) j from best anti join claimed using (game_id, team_id, n)),
free as (select game_id, team_id, ri from (select distinct game_id, team_id from picks), range(5) r(ri) where (game_id, team_id, ri) not in (select game_id, team_id, ri from claimed)),
walk as (select game_id, team_id, 0::bigint j, []::bigint[] path, 0.0::double score, 0 gap from (select distinct game_id, team_id from picks)
  union all select t.game_id, t.team_id, t.j + 1, list_append(t.path, f.ri), t.score + w.pct, greatest(t.gap, (w.pct <= 0)::int) from walk t join rest r on r.game_id = t.game_id and r.team_id = t.team_id and r.j = t.j + 1 join free f on f.game_id = t.game_id and f.team_id = t.team_id and not list_contains(t.path, f.ri) join w on w.game_id = t.game_id and w.team_id = t.team_id and w.n = r.n and w.ri = f.ri),
top as (select game_id, team_id, arg_min(path, (gap, -score, path)) path from walk t where j = (select count(*) from rest r where r.game_id = t.game_id and r.team_id = t.team_id) group by 1, 2),
put as (select r.game_id, r.team_id, r.n, path[r.j] ri, w.pct from top join rest r using (game_id, team_id) join w on w.game_id = r.game_id and w.team_id = r.team_id and w.n = r.n and w.ri = path[r.j]),
sure as (select game_id, team_id, ri, n from claimed union all select game_id, team_id, ri, n from put where pct >= 35), maybe as (select game_id, team_id, ri, n from put where pct >= 10 and pct < 35),
known as (select game_id, team_id, list({{'n': n, 'w': ws}} order by n) ks from (select game_id, team_id, n, list(pct order by ri) ws from w group by 1, 2, 3) group by 1, 2),
spine as (select t.game_id, t.team_id, list(s.n order by r.ri) sures, list(coalesce(s.n, m.n) order by r.ri) seats from (select distinct game_id, team_id from picks) t, range(5) r(ri) left join sure s on s.game_id = t.game_id and s.team_id = t.team_id and s.ri = r.ri left join maybe m on m.game_id = t.game_id and m.team_id = t.team_id and m.ri = r.ri group by 1, 2),
f0 as (select s.*, coalesce(ks, []) ks from spine s left join known using (game_id, team_id)),
{_FILL}
o as (select game_id, team_id, unnest(['top', 'jungle', 'mid', 'bot', 'support']) role_name, unnest(range(5)) ri, unnest(sures) s, unnest(seats) g from f5)
select game_id, team_id, coalesce(string_agg(role_name || '=' || s, ',' order by ri) filter (s is not null), '') confident, coalesce(string_agg(role_name || '=' || g, ',' order by ri) filter (s is null and g is not null), '') guesses from o group by 1, 2""")
def m25_infer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three to five picks of each team."""
    p = views.participants(spark, sf_dir).where((F.col("participant_id") - 1) % 5 < 3 + F.col("game_id") % 3)
    pick = F.struct("participant_id", F.concat(F.lit("C"), "champion").alias("name"), role_weights(F.col("champion")).alias("weights"))
    teams = p.groupBy("game_id", "team_id").agg(F.transform(F.array_sort(F.collect_list(pick)), lambda x: F.struct(x["name"].alias("name"), x["weights"].alias("weights"))).alias("picks"))
    return roles.infer_roles(teams).select("game_id", "team_id", roles.named(F.col("confident")).alias("confident"), roles.named(F.col("guesses")).alias("guesses"))


def expectation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of depth four for each match: a gap, and (a bound or not a short game), and (a place and a bound or a review)."""
    g = F.col("game_id")
    text = F.format_string(
        '{"type": "compound", "sub_expectations": [{"type": "pairwise_minimum_gap", "winner": "1", "loser": "%d", "min_gap": -20000000}, '
        '{"type": "any_of", "sub_expectations": [{"type": "must_not_exceed", "subject": "3", "max_score": 30000000}, {"type": "negation", "sub_expectations": [{"type": "insufficient_evidence", "duration_threshold_seconds": %d}]}]}, '
        '{"type": "compound", "sub_expectations": [{"type": "must_not_rank_first_solely_on_metric", "subject": "2", "metric": "gold"}, %s]}]}',
        12 - g % 3, 400 + g % 1500, F.when(g % 5 == 0, '{"type": "disputed_manual_review"}').otherwise('{"type": "must_not_exceed", "subject": "4", "max_score": 80000000}'),
    )
    return views.matches(spark, sf_dir).select(g.alias("case_id"), "game_id", text.alias("expectation"), "duration")


@query(f"""with {PARTICIPANTS}, {MATCHES}, s as (select game_id, participant_id p, gold_earned v from participants), top as (select game_id, arg_max(p, (v, -p)) t from (select game_id, cast(p as varchar) ps, p, v from s) group by 1),
l as (select m.game_id, duration, (select v from s where s.game_id = m.game_id and p = 1) - (select v from s where s.game_id = m.game_id and p = 12 - m.game_id % 3) >= -20000000 a, (select v from s where s.game_id = m.game_id and p = 3) <= 30000000 b, duration < 400 + m.game_id % 1500 c,
  case when exists (select 1 from s where s.game_id = m.game_id and p = 2) then (select t from top where top.game_id = m.game_id) <> 2 end d, case when m.game_id % 5 > 0 then (select v from s where s.game_id = m.game_id and p = 4) <= 80000000 end e from matches m)
select game_id case_id, a and (b or not c) and (d and e) passed, 5::bigint parts, ((a is not null)::int + (b is not null)::int + (c is not null)::int + (d is not null)::int + (e is not null)::int)::bigint resolved from l""")
def m23_nested_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = views.participants(spark, sf_dir).select("game_id", F.col("participant_id").cast("string").alias("subject"), F.col("gold_earned").alias("score"))
    return expectations.evaluate(expectation_cases(spark, sf_dir), scores, views.matches(spark, sf_dir))


def faulty_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases; what is wrong with one follows from its key."""
    k = F.col("c_custkey") % 17
    bad = {
        5: '{"type": "compound", "sub_expectations": [{"type": "must_not_exceed", "subject": "a"}, {"type": "guess"}]}', 6: '{"type": "compound", "sub_expectations": []}', 7: '{"type": "pairwise_minimum_gap", "winner": "a", "min_gap": 1}',
        8: '{"type": "must_not_exceed", "subject": "a", "max_score": "90"}', 9: '{"type": "negation", "sub_expectations": [{"type": "disputed_manual_review"}, {"type": "disputed_manual_review"}]}', 10: "no json", 11: '{"type": "must_not_rank_first_solely_on_metric", "subject": "a"}',
    }
    text = F.lit('{"type": "any_of", "sub_expectations": [{"type": "must_not_exceed", "subject": "a", "max_score": 90.5}, {"type": "insufficient_evidence", "duration_threshold_seconds": 300}]}')
    for n, x in bad.items():
        text = F.when(k == n, F.lit(x)).otherwise(text)
    note = F.when(k == 12, F.concat(F.lit("RGAPI-"), F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 24))).otherwise("plain")
    c = views.table(spark, sf_dir, "customer").select(
        F.when(k == 13, F.col("c_custkey") - F.pmod("c_custkey", F.lit(34))).otherwise(F.col("c_custkey")).alias("case_id"), F.when(k == 1, "luck").otherwise("tank").alias("category"), F.when(k == 2, "heard").when(k < 14, "verified_local").otherwise("synthetic").alias("verification_status"),
        F.when(k != 3, F.col("c_custkey") + 1).alias("game_id"), F.when(k == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("log"))).alias("provenance"), text.alias("expectation"), note.alias("note"),
    )
    return c.withColumn("json", F.to_json(F.struct("category", "note")))


_FAULTS = {1: ["category"], 2: ["verification_status"], 3: ["verified_without_game"], 4: ["verified_without_provenance"], 5: ["missing_max_score", "unknown_type"], 6: ["no_parts"], 7: ["missing_loser"], 8: ["max_score_not_numeric"], 9: ["negation_of_many"], 10: ["unknown_type"], 11: ["missing_metric"], 12: ["disallowed"]}


@query(f"""with c as (select c_custkey % 17 k, case when c_custkey % 17 = 13 then c_custkey - c_custkey % 34 else c_custkey end case_id from customer)
select case_id, reason from c join (values {", ".join(f"({k}, '{r}')" for k, rs in _FAULTS.items() for r in rs)}) f(k, reason) using (k) union all select case_id, 'duplicate' from c group by case_id having count(*) > 1""")
def p38_library_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectations.library_problems(faulty_library(spark, sf_dir))
