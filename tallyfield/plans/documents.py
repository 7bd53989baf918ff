"""Registered queries: documents that Spark writes from the given tables, read back through the ingest operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators.corpus import pseudonym
from tallyfield.session import scratch
from tallyfield.sources import documents as dc
from tallyfield.sources import ingest, views
from tallyfield.sources.view_sql import EVENTS, FRAMES, MATCHES, PARTICIPANTS


def _written(rows: DataFrame, doc: Column, name: str) -> str:
    """The documents as JSON lines in the shared folder."""
    path = scratch(rows.sparkSession, name)
    rows.select(F.to_json(doc).alias("value")).write.text(path)
    return path


def _by_role(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("role")]


_LANES = {"top": "TOP", "jungle": "JUNGLE", "mid": "MIDDLE", "bot": "BOTTOM", "support": "BOTTOM"}
_SHARES = {"top": "SOLO", "jungle": "NONE", "mid": "SOLO", "bot": "DUO_CARRY", "support": "DUO_SUPPORT"}
_POSITIONS = {"top": "TOP", "jungle": "JUNGLE", "mid": "MIDDLE", "bot": "BOTTOM", "support": "UTILITY"}
_ROSTER_SQL = f"{PARTICIPANTS}, {MATCHES}, games as (select *, case when game_id % 5 = 0 then 1700 else 420 end queue_id, case when game_id % 7 = 0 then 12 else 11 end map_id from matches)"


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.matches(spark, sf_dir)
    k = F.col("game_id")
    return m.select("game_id", F.unix_millis(F.col("creation").cast("timestamp")).alias("creation"), "duration", F.when(k % 5 == 0, 1700).otherwise(420).alias("queue_id"), F.when(k % 7 == 0, 12).otherwise(11).alias("map_id"))


def client_path(spark: SparkSession, sf_dir: str) -> str:
    c = F.col
    stats = F.struct("kills", "deaths", "assists", c("gold_earned").alias("goldEarned"), c("damage_to_champions").alias("totalDamageDealtToChampions"), c("damage_to_objectives").alias("damageDealtToObjectives"), c("damage_to_turrets").alias("damageDealtToTurrets"), c("damage_mitigated").alias("damageSelfMitigated"), c("healing").alias("totalHeal"), c("vision_score").alias("visionScore"), c("wards_placed").alias("wardsPlaced"), c("wards_killed").alias("wardsKilled"), (c("cs") - c("cs") % 3).alias("totalMinionsKilled"), (c("cs") % 3).alias("neutralMinionsKilled"), (c("puuid") % 4).alias("item0"), (c("puuid") % 9).alias("item6"), "win")
    player = F.struct(c("participant_id").alias("participantId"), c("champion").alias("championId"), c("team_id").alias("teamId"), F.struct(_by_role(_LANES).alias("lane"), _by_role(_SHARES).alias("role")).alias("timeline"), stats.alias("stats"))
    who = F.struct(c("participant_id").alias("participantId"), F.struct(F.concat(F.lit("u"), "puuid").alias("puuid"), F.when(c("puuid") % 3 > 0, F.concat(F.lit("n"), "puuid")).alias("gameName"), F.when(c("puuid") % 3 > 1, F.lit("EU")).alias("tagLine")).alias("player"))
    lists = views.participants(spark, sf_dir).groupBy("game_id").agg(F.array_sort(F.collect_list(player)).alias("participants"), F.array_sort(F.collect_list(who)).alias("participantIdentities"))
    d = lists.join(_games(spark, sf_dir), "game_id")
    doc = F.struct(c("game_id").alias("gameId"), c("queue_id").alias("queueId"), c("map_id").alias("mapId"), c("duration").alias("gameDuration"), c("creation").alias("gameCreation"), "participants", "participantIdentities")
    return _written(d, doc, "client")


@query(f"""with {_ROSTER_SQL} select p.game_id, p.participant_id, 'u' || p.puuid puuid, case p.puuid % 3 when 0 then 'Player ' || p.participant_id when 1 then 'n' || p.puuid else 'n' || p.puuid || '#EU' end "name",
p.champion champion_id, p.team_id, p.role, p.win, p.kills, p.deaths, p.gold_earned, p.damage_to_champions, p.vision_score, p.cs, case when p.puuid % 4 > 0 then 1 else 0 end + case when p.puuid % 9 > 0 then 1 else 0 end n_items, g.creation, g.duration
from participants p join games g using (game_id) where g.queue_id = 420 and g.map_id = 11 and g.game_id > 0 and (select count(*) from participants q where q.game_id = p.game_id) = 10""")
def p1_p6_client_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dc.normalise_client(ingest.read_documents(spark, client_path(spark, sf_dir), dc.CLIENT))
    return rows.select("game_id", "participant_id", "puuid", "name", "champion_id", "team_id", "role", "win", "kills", "deaths", "gold_earned", "damage_to_champions", "vision_score", "cs", F.size("items").alias("n_items"), F.col("creation").cast("timestamp_ntz").alias("creation"), "duration")


def research_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers come plain or wrapped; a role is missing in each ninth game."""
    c = F.col
    wrapped = lambda x: F.to_json(F.struct(x.cast("string").alias("$numberLong")))
    position = F.when((c("game_id") % 9 == 0) & (c("participant_id") == 3), "").otherwise(_by_role(_POSITIONS))
    text = lambda x: x.cast("string")
    player = F.struct(c("participant_id").cast("string").alias("participantId"), F.concat(F.lit("u"), "puuid", F.lit("-"), "participant_id").alias("puuid"), text(c("team_id")).alias("teamId"), text(c("champion")).alias("championId"), position.alias("teamPosition"), text(c("kills")).alias("kills"), text(c("deaths")).alias("deaths"), wrapped(c("gold_earned")).alias("goldEarned"), text(c("cs")).alias("totalMinionsKilled"), "win")
    lists = views.participants(spark, sf_dir).groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("participant_id", player.alias("p")))).alias("ps")).withColumn("participants", F.transform("ps", lambda x: x["p"]))
    d = lists.join(_games(spark, sf_dir), "game_id")
    info = F.struct(text(c("game_id")).alias("gameId"), text(c("queue_id")).alias("queueId"), text(c("map_id")).alias("mapId"), text(c("duration")).alias("gameDuration"), wrapped(c("creation")).alias("gameCreation"), F.lit("14.3.1").alias("gameVersion"), "participants")
    return ingest.read_documents(spark, _written(d, F.struct(F.struct(F.concat(F.lit("NA1_"), "game_id").alias("matchId")).alias("metadata"), info.alias("info")), "research"), ingest.MATCH)


_ELIGIBLE = f"{_ROSTER_SQL}, sized as (select game_id, count(*) n from participants group by 1), ruled as (select g.*, case when queue_id <> 420 then 'queue' when map_id <> 11 then 'map' when n <> 10 then 'participant_count' when duration < 300 then 'too_short' when game_id % 9 = 0 then 'roles' else 'accepted' end reason from games g join sized using (game_id))"


@query(f"""with {_ELIGIBLE} select p.game_id, participant_id, 'p_' || substr(sha256('salt' || 'u' || puuid || '-' || participant_id), 1, 24) puuid, team_id, role, win, kills, deaths, gold_earned, cs, creation, duration, '14.3' patch
from participants p join ruled r on r.game_id = p.game_id where reason = 'accepted'""")
def p2_p4_p7_research_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.normalise(research_documents(spark, sf_dir), "salt")
    return rows.select("game_id", "participant_id", "puuid", "team_id", "role", "win", "kills", "deaths", "gold_earned", "cs", F.col("creation").cast("timestamp_ntz").alias("creation"), "duration", "patch")


@query(f"with {_ELIGIBLE} select reason, count(*) documents from ruled group by reason")
def p3_a37_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.tally(ingest.rejection(research_documents(spark, sf_dir)))


def timeline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    raw = F.create_map(*[F.lit(x) for k, v in ingest.EVENT_KINDS.items() for x in (v, k)])
    e = views.timeline_events(spark, sf_dir)
    event = F.struct(c("t_ms").cast("double").alias("timestamp"), "event_id", raw[c("kind")].alias("type"), c("killer").alias("killerId"), c("victim").alias("victimId"), F.array_compact(F.array("assist")).alias("assistingParticipantIds"), c("lane").alias("laneType"), c("building_type").alias("buildingType"), c("monster_type").alias("monsterType"), F.struct(c("x").cast("double").alias("x"), c("y").cast("double").alias("y")).alias("position"))
    minute = F.least(F.lit(36), F.floor(c("t_ms") / 60000) + 1).cast("int")
    events = e.groupBy("game_id", minute.alias("minute")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    state = F.struct(c("participant_id").alias("participantId"), c("gold").cast("int").alias("totalGold"), F.struct(c("x").cast("double").alias("x"), c("y").cast("double").alias("y")).alias("position"))
    frames = views.frames(spark, sf_dir).groupBy("game_id", (c("t_ms") / 60000).cast("int").alias("minute")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c("participant_id").cast("string").alias("k"), state.alias("v"))))).alias("participantFrames"))
    each = frames.join(events, ["game_id", "minute"], "left").groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("minute", (c("minute") * 60000.0).alias("timestamp"), "events", "participantFrames")), lambda a, b: a["minute"] - b["minute"]).alias("frames"))
    doc = F.struct(F.struct(F.concat(F.lit("NA1_"), "game_id").alias("matchId")).alias("metadata"), F.struct("frames").alias("info"))
    return ingest.read_documents(spark, _written(each, doc, "timelines"), ingest.TIMELINE)


@query(f"with {EVENTS} select 'NA1_' || game_id match_id, t_ms, kind, killer, victim, case when assist is null then 0 else 1 end n_assists, lane, building_type, monster_type, x::double x, y::double y from timeline")
def s2_p14_timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ingest.canonical_events(timeline_documents(spark, sf_dir))
    return e.select("match_id", F.col("t_ms").cast("long").alias("t_ms"), "kind", "killer", "victim", F.size("assists").alias("n_assists"), "lane", "building_type", "monster_type", "position.x", "position.y")


@query(f"with {EVENTS}, {FRAMES} select 'NA1_' || game_id match_id, participant_id, t_ms, gold::bigint gold, x::double x, y::double y from frames")
def p15_frame_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ingest.canonical_frames(timeline_documents(spark, sf_dir))
    return f.select("match_id", "participant_id", F.col("t_ms").cast("long").alias("t_ms"), F.col("gold").cast("long").alias("gold"), "position.x", "position.y")


@query(f"""with {EVENTS}, {FRAMES}, d as (select distinct game_id, game_id % 3 * 300 + 1800 duration from frames)
select 'NA1_' || d.game_id match_id, round(least(1, 2160000.0 / (duration * 1000)) * least(1, 36.0 / (floor(duration * 1000 / 60000) + 1)), 4) completeness, true ordered from d""")
def p10_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games are said to last 30, 35 or 40 minutes; 36 frames are there."""
    f = ingest.canonical_frames(timeline_documents(spark, sf_dir))
    games = views.timeline_events(spark, sf_dir).select("game_id").distinct()
    return ingest.completeness(f, games.select(F.concat(F.lit("NA1_"), "game_id").alias("match_id"), (F.col("game_id") % 3 * 300 + 1800).alias("duration")))


@query(f"""with {EVENTS}, {FRAMES}, k as (select distinct game_id, victim participant_id from timeline where kind = 'champion_kill') select game_id, count(*) filter (k.game_id is null) as unknown from (select distinct game_id, participant_id from frames) left join k using (game_id, participant_id) group by 1""")
def p10_known_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with frames who never died."""
    dead = views.timeline_events(spark, sf_dir).where("kind = 'champion_kill'").select("game_id", F.col("victim").alias("participant_id"))
    return dc.known_participants(views.frames(spark, sf_dir), dead, "game_id")


@query(f"""with {PARTICIPANTS}, a as (select game_id, list_sort(list(distinct puuid)) l from participants group by 1), b as (select game_id, list_sort(list(distinct puuid)) l from participants where kills + deaths + assists > 3 group by 1)
select game_id, case when b.l is null then 'missing_right' when a.l = b.l then 'equal' else 'different' end status from a left join b using (game_id)""")
def p11_p12_same_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All players of a game against those with more than three events."""
    p = views.participants(spark, sf_dir)
    return dc.same_players(p, p.where("kills + deaths + assists > 3"), "game_id")


@query(f"""with {MATCHES} select game_id, case when duration < 600 then 'under_10m' when duration < 1500 then '10_25m' when duration < 2400 then '25_40m' else '40m_plus' end wide, case when duration < 1200 then 'under_20m' when duration < 1800 then '20_30m' else '30m_plus' end narrow from matches""")
def p22_duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.matches(spark, sf_dir)
    return m.select("game_id", dc.duration_bucket(F.col("duration")).alias("wide"), dc.duration_bucket(F.col("duration"), (20, 30)).alias("narrow"))


_ODD = "['note', 'api-token', 'Summoner_Name', 'kills', 'mvp', 'Total-Score', 'killer'][c_custkey % 7 + 1]"
_VALUE = "case c_custkey % 5 when 0 then 'RGAPI-' || substr(sha256(cast(c_custkey as varchar)), 1, 24) when 1 then repeat('Ab_', 25) when 2 then sha256(cast(c_custkey as varchar)) when 3 then sha256(cast(c_custkey as varchar)) || sha256('x') else 'plain' end"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("note", "api-token", "Summoner_Name", "kills", "mvp", "Total-Score", "killer")]), (k % 7 + 1).cast("int"))
    digest = F.sha2(k.cast("string"), 256)
    value = F.when(k % 5 == 0, F.concat(F.lit("RGAPI-"), F.substring(digest, 1, 24))).when(k % 5 == 1, F.lit("Ab_" * 25)).when(k % 5 == 2, digest).when(k % 5 == 3, F.concat(digest, F.sha2(F.lit("x"), 256))).otherwise("plain")
    return views.table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.create_map(name, F.array(value, F.lit("b"))).alias("deep"), F.lit(3).alias("n"))).alias("doc"))


@query(f"""with n as (select c_custkey, {_ODD} k, {_VALUE} v from customer)
select c_custkey, 'key:' || lower(k) problem from n where k in ('api-token', 'Summoner_Name') union all select c_custkey, 'developer_key' from n where v like 'RGAPI-%' union all select c_custkey, 'raw_identifier' from n where v like 'Ab#_%' escape '#'""")
def p27_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.secrets(_notes(spark, sf_dir), "doc", "c_custkey")


@query(f"with n as (select c_custkey, {_ODD} k from customer) select c_custkey, replace(lower(k), '-', '_') field, case when k = 'killer' then 'reference' else 'score' end kind from n where k in ('mvp', 'Total-Score', 'killer')")
def p28_judge_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.judge_leaks(_notes(spark, sf_dir), "doc", "c_custkey")


@query(f"with {PARTICIPANTS} select game_id, role, kills, deaths, assists, gold_earned, cs, damage_to_champions, damage_to_objectives, damage_to_turrets, damage_mitigated, healing, vision_score, wards_placed, wards_killed from participants")
def p29_presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.presented(views.participants(spark, sf_dir), "game_id")


_SOURCES = "['match_v5', 'lcu_timeline', 'live_client', 'aggregate', 'other']"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda x, names: F.element_at(F.array(*[F.lit(n) for n in names]), (x % len(names) + 1).cast("int"))
    o = views.table(spark, sf_dir, "orders")
    return o.select(F.floor(k / 3).cast("long").alias("game_id"), pick(F.floor(k / 6), (*dc.TIER_FLAGS, "other")).alias("source"), F.col("o_orderpriority").alias("payload"), (k % 13 / 10).alias("completeness"), pick(k, (*dc.PRIVACY, "open")).alias("privacy_classification"), F.lit("unknown").alias("consent_status"), F.when(k % 8 > 0, F.array(F.col("o_custkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("player_group_keys"))


_ENTRIES = f"""e as (select o_orderkey // 3 game_id, {_SOURCES}[(o_orderkey // 6) % 5 + 1] source, sha256(o_orderpriority) h, least(1.0, (o_orderkey % 13) / 10) c, o_orderkey k from orders), i as (select *, game_id || ':' || source entry_id from e)"""


@query(f"""with {_ENTRIES} select entry_id, 'source' problem from i where source = 'other' union all select entry_id, 'capability_flags' from i where source = 'other' union all select entry_id, 'privacy_classification' from i where k % 3 = 2
union all select entry_id, 'game_id' from i where game_id <= 0 union all select entry_id, 'player_group_keys' from i where k % 8 = 0 union all select entry_id, 'content_hash' from i group by entry_id having count(distinct h) > 1""")
def p31_p32_manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.manifest_problems(dc.manifest_entries(_facts(spark, sf_dir)))


@query(f"with {_ENTRIES} select source, count(*) entries, round(avg(c), 4) mean_completeness from i group by source")
def s5_a16_manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest written as JSON and read back."""
    entries, path = dc.manifest_entries(_facts(spark, sf_dir)), scratch(spark, "manifest")
    dc.write_manifest(entries, path)
    return dc.manifest_stats(spark.read.schema(entries.schema).json(path))


@query("select count(*) filter (doc_id % 6 = 0) skipped, count(*) filter (doc_id % 6 > 0) kept from labels")
def s3_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sixth line is cut off."""
    d = F.col("doc_id")
    line = F.to_json(F.struct(d.cast("string").alias("label_id"), F.lit("p").alias("pair_id"), F.lit("r").alias("reviewer_id"), F.when(F.col("quality") == 1, "left").otherwise("right").alias("choice"), F.lit(0.5).alias("confidence")))
    path = scratch(spark, "labels")
    views.table(spark, sf_dir, "labels").select(F.when(d % 6 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return dc.read_labels(spark, path)[1]


@query(f"with {MATCHES} select game_id, duration from matches where game_id in (select c_custkey from customer where c_nationkey < 5)")
def s11_only_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of customer keys as game ids, with lines that are none."""
    path, c = scratch(spark, "ids"), views.table(spark, sf_dir, "customer")
    c.select(F.when(F.col("c_nationkey") < 5, F.concat(F.lit(" "), "c_custkey")).otherwise("no id").alias("value")).write.text(path)
    return dc.only_listed(views.matches(spark, sf_dir).select("game_id", "duration"), path)


def item_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of each brand's parts as a document."""
    c = F.col
    gold = F.struct(F.floor(c("p_retailprice")).cast("int").alias("total"), (c("p_size") % 10 > 0).alias("purchasable"))
    stats = F.create_map(F.lit("FlatArmorMod"), (c("p_size") % 3 * 10.0), F.lit("FlatSpellBlockMod"), (c("p_size") % 4 * 5.0))
    item = F.struct(c("p_name").alias("name"), F.array(c("p_type")).alias("tags"), gold.alias("gold"), stats.alias("stats"), F.create_map(F.lit("11"), c("p_size") % 2 == 0).alias("maps"))
    docs = views.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct((c("p_partkey") * 100).cast("string").alias("k"), item.alias("v")))).alias("data"))
    return spark.read.schema(f"data map<string, {dc.ITEM}>").json(_written(docs, F.struct("data"), "items"))


@query("select cast(p_partkey * 100 as integer) item_id, p_name \"name\", cast(floor(p_retailprice) as integer) gold, p_size % 3 * 10 armor, p_size % 4 * 5 mr, 0 hp, p_type tag, 0 \"depth\", p_size % 2 = 0 and p_partkey * 100 < 100000 sr from part where p_size % 10 > 0")
def s13_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.items(item_catalogue(spark, sf_dir)).withColumn("tag", F.get("tags", F.lit(0))).drop("tags")


@query("select p_name \"name\", p_size * 15 attack_range, case when p_size * 15 between 1 and 350 then 'melee' else 'ranged' end range_type, p_partkey % 2 n_tags from part")
def s13_champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    champion = F.struct(c("p_name").alias("name"), F.when(c("p_partkey") % 2 == 1, F.array(c("p_brand"))).alias("tags"), F.struct((c("p_size") * 15.0).alias("attackrange")).alias("stats"))
    docs = views.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct(c("p_partkey").cast("string").alias("k"), champion.alias("v")))).alias("data"))
    read = spark.read.schema("data map<string, struct<name: string, tags: array<string>, stats: struct<attackrange: double>>>").json(_written(docs, F.struct("data"), "champions"))
    return dc.champions(read).select("name", "attack_range", "range_type", F.size("tags").alias("n_tags"))


@query(f"with {PARTICIPANTS} select game_id, participant_id, 'p_' || substr(sha256('s' || cast(puuid as varchar)), 1, 24) alias from participants")
def p9_leak_free_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir)
    return p.select("game_id", "participant_id", pseudonym(F.col("puuid"), "s").alias("alias"))
