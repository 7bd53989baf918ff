"""Registered queries: corpora and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import corpus
from tallyfield.operators.components import connected_components
from tallyfield.sources import views
from tallyfield.sources.view_sql import PAIRS, PARTICIPANTS


#: Games are even nodes, players odd ones; a node's smallest reachable node by recursion that keeps one row a node.
COMPONENTS = """edges as (select (o_orderkey // 10) * 2 a, o_custkey * 2 + 1 b from orders), ways as (select a, b from edges union select b, a from edges),
comp(node, component) using key (node) as (select distinct a, a from ways union select w.b, min(c.component) from comp c join ways w on w.a = c.node join recurring.comp r on r.node = w.b where c.component < r.component group by w.b)"""


@query(f"with recursive {COMPONENTS} select node, component from comp")
def m7_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.player_edges(spark, sf_dir)
    return connected_components(e.select((F.col("game_id") * 2).alias("src"), (F.col("puuid") * 2 + 1).alias("dst")))


@query(f"""with recursive {COMPONENTS}, u as (select node // 2 game_id, component, cast('0x' || substr(sha256('0:' || component), 1, 13) as bigint) / pow(2, 52) x from comp where node % 2 = 0)
select game_id, component, case when x < 0.1 then 'test' when x < 0.9 then 'train' else 'validation' end split from u""")
def m6_assign_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.assign_splits(views.player_edges(spark, sf_dir), "game_id", "puuid")


_SPLIT = "case when cast('0x' || substr(sha256(cast(game_id as varchar)), 1, 2) as integer) < 26 then 'test' else 'train' end"


def _split(c: str):
    return F.when(F.conv(F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 2), 16, 10).cast("int") < 26, "test").otherwise("train")


@query(f"with {PARTICIPANTS}, s as (select distinct puuid, {_SPLIT} split from participants) select puuid, string_agg(split, ',' order by split) splits from s group by puuid having count(*) > 1")
def m8_check_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.participants(spark, sf_dir).select("puuid", _split("game_id").alias("split"))
    return corpus.check_leakage(rows, "puuid").select("puuid", F.array_join("splits", ",").alias("splits"))


@query("""with s as (select event_id, epoch(ts)::bigint t, case when cast('0x' || substr(sha256(cast(event_id as varchar)), 1, 2) as integer) < 26 then 'test' else 'train' end split from events),
n as (select *, lead(event_id) over w e2, lead(t) over w t2, lead(split) over w s2 from (select event_id, floor(epoch(ts))::bigint t, case when cast('0x' || substr(sha256(cast(event_id as varchar)), 1, 2) as integer) < 26 then 'test' else 'train' end split from events) window w as (order by t, event_id))
select event_id id, e2 next_id from n where t2 - t <= 300 and s2 <> split and (t // 3600 = t2 // 3600 or t // 3600 + 1 = t2 // 3600)""")
def w10_near_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), _split("event_id").alias("split"))
    return corpus.near_in_time(e, "ts", "event_id")


@query("""with s as (select doc_id, lang, source, count(*) over (partition by lang, source) size, sha256('0:' || cast(doc_id as varchar)) h from documents),
r as (select *, row_number() over (partition by lang, source order by h, doc_id) "round" from s) select doc_id, lang, source, cast("round" as integer) "round" from r order by "round", size desc, lang, source limit 200""")
def k5_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return corpus.stratified_sample(docs, ["lang", "source"], "doc_id", 200)


@query(f"""with {PAIRS}, i as (select distinct substr(sha256(cast(least(left_ref, right_ref) as varchar) || '|' || cast(greatest(left_ref, right_ref) as varchar)), 1, 20) pair_id, cast(least(left_ref, right_ref) as varchar) a, cast(greatest(left_ref, right_ref) as varchar) b from pairs),
j as (select *, cast('0x' || substr(sha256('0:' || pair_id), 1, 1) as integer) % 2 = 1 swap from i)
select pair_id, case when swap then b else a end left_ref, case when swap then a else b end right_ref, substr(sha256('0:' || pair_id || ':left'), 1, 12) left_token, substr(sha256('0:' || pair_id || ':right'), 1, 12) right_token from j""")
def m10_blind_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.blind_pairs(views.label_pairs(spark, sf_dir))


_TIERS = f"""{PARTICIPANTS}, tiers as (select game_id, r.r "round", v.v reviewer, participant_id item, cast((kills * v.v + assists + r.r * (participant_id % 2)) % 6 as integer) tier, 50 + (cs + v.v) % 50 confidence from participants, range(1, 3) r(r), range(1, 4) v(v))"""


@query(f"""with {_TIERS}, p as (select a.game_id, a.item a, b.item b, a.reviewer, a."round", sign(b.tier - a.tier) p, abs(b.tier - a.tier) gap, least(a.confidence, b.confidence) c from tiers a join tiers b on a.game_id = b.game_id and a."round" = b."round" and a.reviewer = b.reviewer and a.item < b.item),
s as (select game_id, a, b, reviewer, min(p) lo, avg(gap) gap, min(c) c from p group by 1, 2, 3, 4 having count(distinct "round") = 2 and min(p) = max(p) and min(p) <> 0),
v as (select game_id, a, b, count(*) n, count(*) filter (lo > 0) f, avg(gap) gap, min(c) c from s group by 1, 2, 3)
select game_id "match", a, b, case when f * 2 > n then a else b end winner, n, c confidence from v where n >= 2 and greatest(f, n - f) >= 0.66 * n and gap <= 9 and f * 2 <> n""")
def m9_a19_panel_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir)
    both = p.withColumn("round", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("reviewer", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    c = F.col
    tiers = both.select(c("game_id").alias("match"), "round", "reviewer", c("participant_id").alias("item"), ((c("kills") * c("reviewer") + c("assists") + c("round") * (c("participant_id") % 2)) % 6).cast("int").alias("tier"), (50 + (c("cs") + c("reviewer")) % 50).alias("confidence"))
    return corpus.panel_consensus(tiers)


@query("select l_orderkey, count(distinct l_returnflag) hashes from lineitem group by l_orderkey having count(distinct l_returnflag) > 1")
def p32_manifest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem").select("l_orderkey", F.sha2("l_returnflag", 256).alias("content_hash"))
    return corpus.manifest_conflicts(line, "l_orderkey")


@query(f"with {PAIRS} select left_ref, right_ref from pairs where left_ref in (select doc_id from labels where toxic = 0) and right_ref in (select doc_id from labels where toxic = 0)")
def j19_resolvable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = views.table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("item_ref"))
    return corpus.resolvable(views.label_pairs(spark, sf_dir).select("left_ref", "right_ref"), clean)


@query("""select l_orderkey id, rule from (select l_orderkey, unnest(list_filter([case when l_discount > 0.05 then 'discount' end, case when l_quantity < 5 then 'quantity' end], lambda x: x is not null)) rule from lineitem)""")
def p30_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    return corpus.violations(line, "id", {"discount": F.col("l_discount") <= 0.05, "quantity": F.col("l_quantity") >= 5})


@query("select c_custkey, 'p_' || substr(sha256('s' || cast(c_custkey as varchar)), 1, 24) alias from customer")
def p8_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey", corpus.pseudonym(F.col("c_custkey"), "s").alias("alias"))


_KEYS = ("kills", "nexus_kills", "gameEnd", "end-of game", "game_creation", "over_game", "teamWin", "window_ms", "surrendered", "Remakes", "frame_end", "defeatedBy", "result", "winning_gold", "gameOver", "victories")
_TELL = ("nexus_kills", "gameEnd", "over_game", "teamWin", "surrendered", "Remakes", "defeatedBy", "result", "gameOver", "victories")


@query(f"""with k as (select c_custkey, [{", ".join(f"'{k}'" for k in _KEYS)}] ks from customer), d as (select c_custkey, unnest([ks[c_custkey % 16 + 1], ks[c_custkey * 7 % 16 + 1]]) as key from k)
select distinct c_custkey, key from d where key in ({", ".join(f"'{k}'" for k in _TELL)})""")
def p26_leaked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys a document, one inside the other's list."""
    names = F.array(*[F.lit(k) for k in _KEYS])
    c = F.col("c_custkey")
    outer, inner = (F.element_at(names, (x % 16 + 1).cast("int")) for x in (c, c * 7))
    docs = views.table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.create_map(outer, F.array(F.create_map(inner, F.lit(1))))).alias("doc"))
    return corpus.leaked_keys(docs, "doc", "c_custkey")
