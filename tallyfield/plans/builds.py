"""Registered queries: build records, levelling steps, keyset pages and checks of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import builds, corpus
from tallyfield.operators.paging import KeysetTable
from tallyfield.session import scratch
from tallyfield.sources import views
from tallyfield.sources.view_sql import MATCHES, PARTICIPANTS


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as provider payloads: 0 and 7 whole, 1 with texts for numbers and without shards, 2 with other fields, 3 to 6 unfit."""
    c = F.col("c_custkey")
    k = c % 8
    runes = [8000 + c % 10 + i for i in range(4)] + [8200 + c % 7, 8201 + c % 7]
    text = lambda form, *xs: F.format_string(form, *xs)
    whole = text('{"rune_pages": [{"builds": [{"primary_page_id": 8300, "secondary_page_id": 8400, "primary_rune_ids": [%d, %d, %d, %d], "secondary_rune_ids": [%d, %d], "stat_mod_ids": [5005, 5007, 5011]}]}], "summoner_spells": [{"ids": [4, %d]}], "starter_items": [{"ids": [1055, 2003]}], "core_items": [{"ids": [3031, %d]}], "last_items": [{"ids": [3036, 1]}, {"ids": []}, {"ids": [%d]}, {"ids": [9]}]}', *runes, c % 15, 3000 + c % 90, 3100 + c % 9)
    texts = text('{"rune_pages": [{"builds": [{"primary_page_id": "8300", "primary_rune_ids": ["%d", "%d", "%d", "%d"], "secondary_rune_ids": ["%d", "%d"]}]}], "summoner_spells": [], "core_items": [{"ids": ["%d"]}]}', *runes, 3000 + c % 90)
    other = text('{"v": 3, "rune_pages": [{"pick": 0.5, "builds": [{"x": {"y": []}, "primary_rune_ids": [%d, %d, %d, %d], "secondary_rune_ids": [%d, %d], "stat_mod_ids": []}, {"primary_rune_ids": []}]}, {}], "starter_items": [{"ids": [%d]}], "last_items": [{}, {"ids": [%d, 5]}]}', *runes, 1001 + c % 5, 3100 + c % 9)
    few = text('{"rune_pages": [{"builds": [{"primary_rune_ids": [%d, %d, %d], "secondary_rune_ids": [1, 2]}]}]}', *runes[:3])
    line = F.when(k == 1, texts).when(k == 2, other).when(k == 3, '{"rune_pages": [{"builds": []}]}').when(k == 4, '{"rune_pages": []}').when(k == 5, few).when(k == 6, "busy").otherwise(whole)
    return views.table(spark, sf_dir, "customer").select("c_custkey", k.alias("shape"), line.alias("payload"))


@query("""with c as (select c_custkey c, c_custkey % 8 k from customer), r as (select *, concat_ws(',', 8000 + c % 10, 8001 + c % 10, 8002 + c % 10, 8003 + c % 10, 8200 + c % 7, 8201 + c % 7) runes from c)
select c c_custkey, case k when 3 then 'no_build' when 4 then 'no_rune_pages' when 5 then 'runes' when 6 then 'not_json' end problem, case when k in (0, 7, 1) then 8300 when k = 2 then 8000 end primary_style_id, case when k in (0, 7) then 8400 when k in (1, 2) then 8100 end sub_style_id,
case when k in (0, 7) then runes || ',5005,5007,5011' when k in (1, 2) then runes || ',5008,5008,5001' end rune_ids, case when k in (0, 7) then '4,' || c % 15 when k in (1, 2) then '' end spells, case when k in (0, 7) then '1055,2003' when k = 1 then '' when k = 2 then cast(1001 + c % 5 as varchar) end items_start,
case when k in (0, 7) then '3031,' || (3000 + c % 90) when k = 1 then cast(3000 + c % 90 as varchar) when k = 2 then '' end items_core, case when k in (0, 7) then '3036,' || (3100 + c % 9) when k = 1 then '' when k = 2 then cast(3100 + c % 9 as varchar) end items_fourth from r""")
def p40_build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = ("rune_ids", "spells", "items_start", "items_core", "items_fourth")
    return builds.build_records(payloads(spark, sf_dir)).drop("payload", "shape").withColumns({c: builds.joined(F.col(c)) for c in lists})


@query("select c_custkey % 8 shape, count(*) payloads, count(*) filter (c_custkey % 8 = 6) unread from customer group by 1")
def p40_payload_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many payloads of each kind can be read; the merged shapes are for people."""
    return builds.payload_shapes(payloads(spark, sf_dir), "shape", payload="payload").toDF("k", "payloads", "unread", "schema").select(F.col("k").alias("shape"), "payloads", "unread")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with the order of their champion (every fifth has none), what they own, and their level."""
    p = views.participants(spark, sf_dir)
    ability = lambda x: F.element_at(F.array(*[F.lit(a) for a in builds.ABILITIES]), (F.pmod(x, F.lit(4)) + 1).cast("int"))
    sequence = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: ability(i * (F.col("champion") % 3 + 1) + F.col("champion")))
    owned = {"Q": F.col("kills") % 6, "W": F.col("deaths") % 6, "E": F.col("assists") % 6, "R": F.col("cs") % 4}
    ranks = F.create_map(*[x for a, n in owned.items() for x in (F.lit(a), n.cast("int"))])
    priority = F.when(F.col("champion") % 3 == 0, F.array(F.lit("W"), F.lit("E"))).when(F.col("champion") % 3 == 1, F.array(F.lit("E")))
    return p.select("game_id", "participant_id", F.when(F.col("champion") % 5 > 0, sequence).alias("sequence"), ranks.alias("ranks"), (F.col("cs") % 18 + 1).cast("int").alias("level"), priority.alias("priority"))


@query(f"""with {PARTICIPANTS}, a as (select game_id, participant_id, champion, kills % 6 q, deaths % 6 w, assists % 6 e, cs % 4 r, cs % 18 + 1 lvl from participants),
s as (select *, ['Q', 'W', 'E', 'R'][(i * (champion % 3 + 1) + champion) % 4 + 1] ab, i from a, range(15) t(i) where champion % 5 > 0), n as (select *, count(*) over (partition by game_id, participant_id, ab order by i) seen from s),
f as (select game_id, participant_id, arg_min(ab, i) step from n where seen > case ab when 'Q' then q when 'W' then w when 'E' then e else r end group by 1, 2),
g as (select *, greatest(lvl, q + w + e + r + 1) t from a), h as (select *, case when t >= 16 then 3 when t >= 11 then 2 when t >= 6 then 1 else 0 end ult, least(5, (t + 1) // 2) cap from g),
o as (select h.*, u.ab, u.k, case u.ab when 'Q' then q when 'W' then w else e end own from h, (values (0, 'W', 1), (0, 'E', 2), (0, 'Q', 3), (1, 'E', 1), (1, 'Q', 2), (1, 'W', 3), (2, 'Q', 1), (2, 'W', 2), (2, 'E', 3)) u(m, ab, k) where u.m = champion % 3),
b as (select game_id, participant_id, arg_min(ab, k) filter (own < cap) b1, arg_min(ab, k) filter (own < 5) b2 from o group by 1, 2)
select game_id, participant_id, coalesce(step, case when q >= 5 and w >= 5 and e >= 5 and r >= 3 then null when r < ult then 'R' else coalesce(b1, b2, case when r < 3 then 'R' end) end) next_step from h left join f using (game_id, participant_id) left join b using (game_id, participant_id)""")
def w13_next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builds.next_step(levels(spark, sf_dir)).select("game_id", "participant_id", "next_step")


@query(f"with {MATCHES}, o as (select game_id, creation, queue, row_number() over (order by creation desc, game_id desc) r from matches) select game_id, creation, queue, cast((r - 1) // 100 + 1 as integer) page from o where r <= 500")
def k2_keyset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five pages of a hundred games, each found by the last row of the one before."""
    m = views.matches(spark, sf_dir).select("game_id", "creation", "queue")
    pages = KeysetTable.write(m, F.unix_micros(F.col("creation").cast("timestamp")), F.col("game_id"), scratch(spark, "history-pages"), 400)
    out, after = None, None
    for number in range(1, 6):
        page = pages.page(after, 100)
        last = page.orderBy("k1", "k2").select("k1", "k2").first()
        out = page.withColumn("page", F.lit(number)) if out is None else out.unionByName(page.withColumn("page", F.lit(number)))
        if last is None:
            break
        after = tuple(last)
    return out.select("game_id", "creation", "queue", "page")


_ENTRY = {"player": "puuid", "match": "game_id", "content": "concat_ws('|', kills, deaths, assists, gold_earned)"}
_VALUE = {"champion": "champion", "region": "case when puuid % 7 > 0 then puuid % 50 end", "rank_tier": "gold_earned // 1000000", "patch": "game_id // 40"}
_SPLITS = "case when cast('0x' || substr(sha256(cast(game_id as varchar)), 1, 2) as integer) < 26 then 'test' else 'train' end"


@query(f"""with {PARTICIPANTS}, e as (select *, {_SPLITS} split from participants),
u as ({" union all ".join(f"select '{a}' attribute, cast({x} as varchar) value, split, '{kind}' kind from e" for kind, ps in (("hard", _ENTRY), ("soft", _VALUE)) for a, x in ps.items())}),
c as (select attribute, value, kind, split, count(*) n from u where value is not null group by all), t as (select attribute, value, kind, sum(n) total, count(*) k, max(n) most, string_agg(split, ',' order by split) splits, sum(n) s0, -sum(n * log2(n)) sl from c group by 1, 2, 3)
select attribute, value, case when kind = 'hard' then 'leak' else 'concentrated' end finding, splits, total::bigint n, round(most / total, 9) largest_share, round(log2(total) + sl / total, 9) entropy from t where (kind = 'hard' and k > 1) or (kind = 'soft' and k = 1 and total > 1)
union all select 'split', split, 'count', split, count(*), round(count(*) / (select count(*) from e), 9), 0.0 from e group by split""")
def m8_check_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants as entries, split by game."""
    p = views.participants(spark, sf_dir)
    test = F.conv(F.substring(F.sha2(F.col("game_id").cast("string"), 256), 1, 2), 16, 10).cast("int") < 26
    rows = p.select(
        F.when(test, "test").otherwise("train").alias("split"), F.col("puuid").alias("player"), F.col("game_id").alias("match"), F.concat_ws("|", "kills", "deaths", "assists", "gold_earned").alias("content"),
        "champion", F.when(F.col("puuid") % 7 > 0, F.col("puuid") % 50).alias("region"), F.floor(F.col("gold_earned") / 1000000).alias("rank_tier"), F.floor(F.col("game_id") / 40).alias("patch"),
    )
    found = corpus.check_splits(rows, ["player", "match", "content"], ["champion", "region", "rank_tier", "patch"])
    return found.withColumns({"splits": F.array_join("splits", ","), "largest_share": F.round("largest_share", 9), "entropy": F.round("entropy", 9)})
