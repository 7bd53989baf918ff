"""Registered queries: streams over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import SQL, query
from tallyfield.operators.composite import score_composite
from tallyfield.plans import scoring  # noqa: F401 - registers the SQL of the composite
from tallyfield.plans.documents import client_path
from tallyfield.session import scratch
from tallyfield.sources import documents as dc
from tallyfield.sources import views
from tallyfield.sources.view_sql import EVENTS, PARTICIPANTS
from tallyfield.streaming import capture, live


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of polls, landed in two files by time, every event in two polls."""
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    path = scratch(spark, "landing")
    e.repartitionByRange(2, "ts").write.parquet(path)
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return source.withColumn("poll", F.explode(F.array(F.lit(0), F.lit(1)))).drop("poll")


@query("select user_id session_id, event_id, event_type kind from events")
def t1_t2_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.run_available(live.exactly_once(stream(spark, sf_dir)).select("session_id", "event_id", "kind"), "events")


@query("""with e as (select user_id session_id, ts, 'h' || cast(floor(value / 10) as bigint) hash, event_id from events), l as (select *, lag(hash) over (partition by session_id order by ts) b from e) select session_id, event_id, hash from l where hash is distinct from b""")
def t4_changed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream with a table of the sessions' last hashes, the events landing in order of time."""
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("h"), F.floor(F.col("value") / 10).cast("string")).alias("hash"))
    return live.run_changed(_landed(spark, e, 3), "changed").where("session_id is not null").select("session_id", "event_id", "hash")


def _landed(spark: SparkSession, rows: DataFrame, files: int) -> DataFrame:
    """A table that arrives in pieces one after the other in time, and then a row of no session a day later, which closes all windows."""
    path = scratch(spark, "landing")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    edges = [low + (high - low) * k / files for k in range(1, files)]
    for n, (begin, end) in enumerate(zip([None, *edges], [*edges, None])):
        piece = rows if begin is None else rows.where(F.col("ts") >= F.lit(begin))
        (piece if end is None else piece.where(F.col("ts") < F.lit(end))).coalesce(1).write.parquet(f"{path}/{n}")
    last = [F.lit(high) + F.expr("interval 1 day") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns]
    spark.range(1).select(*[x.alias(c) for x, c in zip(last, rows.columns)]).write.parquet(f"{path}/{files}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))


@query("select user_id session_id, arg_min(event_id, ts) event_id from events group by user_id, floor(epoch(ts))::bigint // 15")
def t3_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.run_available(live.throttled(_landed(spark, _polls(spark, sf_dir), 2)), "throttled").where("session_id is not null").select("session_id", "event_id")


@query("""with e as (select user_id session_id, ts, event_type kind, case when ts < lag(ts) over (partition by user_id order by ts) + interval 750 seconds then 0 else 1 end new from events),
n as (select *, sum(new) over (partition by session_id order by ts rows unbounded preceding) k from e)
select session_id, min(ts) "start", count(*) events, case when count(*) filter (kind = 'purchase') > 0 then 'completed' else 'partial_silence' end status from n group by session_id, k""")
def t5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase stands for the end of the game."""
    e = _polls(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "purchase", "GameEnd").otherwise(F.col("kind")))
    found = live.run_available(live.sessions(_landed(spark, e, 2)), "sessions").where("session_id is not null")
    return found.select("session_id", F.col("start").cast("timestamp_ntz").alias("start"), "events", "status")


_SESSIONS = "s as (select user_id session_id, max(ts) updated_at, arg_max(event_type, ts) last_kind, count(*) n from events group by 1), a as (select session_id, updated_at, case when last_kind = 'purchase' then 'completed' else 'active' end status, n from s)"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _polls(spark, sf_dir).groupBy("session_id").agg(F.max("ts").alias("updated_at"), F.max_by("kind", "ts").alias("last_kind"), F.count("*").alias("n"))
    return g.withColumn("status", F.when(F.col("last_kind") == "purchase", "completed").otherwise("active"))


@query(f"with {_SESSIONS}, m as (select max(updated_at) t from s) select session_id, case when status = 'active' and floor(epoch(updated_at)) + 86400 < floor(epoch(t)) then 'partial_process_restart' else status end status from a, m")
def t6_stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day before the newest event of all."""
    s = _sessions(spark, sf_dir)
    newest = s.agg(F.max("updated_at")).first()[0]
    return live.recover_stale(s, F.lit(newest), 86_400).select("session_id", "status")


@query(f"with {_SESSIONS}, g as (select c_custkey session_id, c_nationkey known from customer), j as (select a.session_id, case when n % 3 > 0 then n % 25 end own, known from a left join g using (session_id)) select session_id, coalesce(own, known)::bigint game_id, case when known is null then 'open' when own is null or own = known then 'reconciled' else 'mismatch' end reconciliation from j")
def t7_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir).select("session_id", F.when(F.col("n") % 3 > 0, F.col("n") % 25).alias("game_id"))
    games = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").cast("long").alias("game_id"))
    return live.reconcile(s, games).select("session_id", "game_id", "reconciliation")


_TIMERS = "(values ('dragon', 300, 300, null), ('baron', 1500, 360, null), ('herald', 960, 360, 1500), ('grubs', 480, 240, 960)) x(objective, spawn, respawn, gone_after)"


@query(f"""with {EVENTS}, k as (select game_id session_id, case monster_type when 'DRAGON' then 'dragon' when 'BARON_NASHOR' then 'baron' when 'RIFTHERALD' then 'herald' when 'HORDE' then 'grubs' end objective, t_ms // 1000 t from timeline where kind = 'elite_monster_kill'),
l as (select session_id, objective, max(t) killed from k group by 1, 2), d as (select s.session_id, x.objective, x.gone_after, killed, coalesce(killed + respawn, spawn)::bigint due from (select distinct session_id from k) s cross join {_TIMERS} left join l on l.session_id = s.session_id and l.objective = x.objective)
select session_id, objective, due, case when gone_after is not null and due > gone_after then 'gone' when due <= 2100 then 'alive' when killed is null then 'pending' else 'respawning' end state from d""")
def t10_objective_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.create_map(*[F.lit(x) for kv in {"DRAGON": "dragon", "BARON_NASHOR": "baron", "RIFTHERALD": "herald", "HORDE": "grubs"}.items() for x in kv])
    e = views.timeline_events(spark, sf_dir).where("kind = 'elite_monster_kill'").select(F.col("game_id").alias("session_id"), name[F.col("monster_type")].alias("objective"), F.floor(F.col("t_ms") / 1000).alias("t"))
    return live.objective_timers(e, F.lit(2100)).withColumn("due", F.col("due").cast("long"))


def payload_path(spark: SparkSession, sf_dir: str) -> str:
    """A payload per match: its ten participants as players, and an event for each of them; some parts are missing."""
    c = F.col
    p = views.participants(spark, sf_dir)
    name = F.concat(F.lit("n"), "puuid")
    player = F.struct(c("participant_id").alias("k"), F.concat(F.lit("C"), "champion").alias("championName"), F.when(c("champion") % 2 == 0, name).alias("summonerName"), name.alias("riotIdGameName"), F.lit("EU").alias("riotIdTagLine"), F.when(c("team_id") == 100, "ORDER").otherwise("CHAOS").alias("team"), (c("cs") % 18 + 1).cast("int").alias("level"), (c("deaths") > 2).alias("isDead"), F.array(F.struct((c("champion") + 1).cast("int").alias("itemID")), F.struct((c("participant_id") + 30).cast("int").alias("itemID"))).alias("items"), F.when(c("kills") > 0, F.struct(c("kills").cast("int").alias("kills"), c("cs").cast("int").alias("creepScore"))).alias("scores"))
    event = F.struct(c("participant_id").alias("EventID"), F.element_at(F.array(*[F.lit(x) for x in ("ChampionKill", "DragonKill", "TurretKilled", "MinionsSpawning")]), (c("kills") % 4 + 1).cast("int")).alias("EventName"), (c("participant_id") * 60.5).alias("EventTime"), name.alias("KillerName"), F.concat(F.lit("n"), c("puuid")).alias("VictimName"), F.array(F.concat_ws("#", name, F.lit("EU")), F.lit("nobody")).alias("Assisters"))
    g = p.groupBy("game_id").agg(F.array_sort(F.collect_list(player)).alias("allPlayers"), F.array_sort(F.collect_list(event)).alias("es"), F.max(F.when(c("participant_id") == 4, F.concat(F.lit(" N"), "puuid", F.lit("#eu ")))).alias("me"))
    me = F.when(c("game_id") % 10 != 9, F.struct(c("me").alias("riotId"), F.lit("x").alias("summonerName")))
    doc = F.struct(c("game_id").cast("string").alias("session_id"), "game_id", me.alias("activePlayer"), "allPlayers", F.when(c("game_id") % 10 != 8, F.struct(c("es").alias("Events"))).alias("events"), F.struct((c("game_id") * 1.5).alias("gameTime")).alias("gameData"))
    path = scratch(spark, "payloads")
    g.select(F.to_json(doc).alias("value")).write.text(path)
    return path


def _payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid payloads, names, participants)."""
    read = spark.read.schema(live.PAYLOAD).json(payload_path(spark, sf_dir)).where(live.payload_problem().isNull())
    p = views.participants(spark, sf_dir).select("game_id", "participant_id", F.concat(F.lit("C"), "champion").alias("champion_name"))
    return read, live.name_map(read, p), p


_NAMES = f"""{PARTICIPANTS}, ok as (select distinct game_id from participants where game_id % 10 < 8), once as (select game_id, champion, min(participant_id) pid from participants group by 1, 2 having count(*) = 1),
who as (select p.*, 'n' || puuid nm, o.pid from participants p join ok using (game_id) left join once o on o.game_id = p.game_id and o.champion = p.champion), names as (select game_id, nm, min(pid) pid from who where pid is not null group by 1, 2)"""


@query(f"with {PARTICIPANTS} select case when game_id % 10 = 9 then 'active_player' when game_id % 10 = 8 then 'events' else 'valid' end problem, count(distinct game_id) payloads from participants group by 1")
def s12_p19_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read as a stream of payload files."""
    source = spark.readStream.schema(live.PAYLOAD).json(payload_path(spark, sf_dir))
    checked = live.run_available(source.select("game_id", F.coalesce(live.payload_problem(), F.lit("valid")).alias("problem")), "checked")
    return checked.groupBy("problem").agg(F.count_distinct("game_id").alias("payloads"))


@query(f"with {_NAMES} select game_id, nm \"name\", pid participant_id from names union all select game_id, nm || '#EU', pid from names")
def p16_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir)[1].select("game_id", F.explode("names").alias("name", "participant_id"))


@query(f"""with {_NAMES} select w.game_id, w.participant_id event_id, w.participant_id * 60500.0::double t_ms, ['champion_kill', 'elite_monster_kill', 'building_kill'][w.kills % 4 + 1] kind, n.pid killer, case when w.kills % 4 = 0 then n.pid end victim,
case when w.kills % 4 = 0 and n.pid is not null then 1 else 0 end n_assists from who w left join names n on n.game_id = w.game_id and n.nm = w.nm where w.kills % 4 < 3""")
def p17_live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    read, names, _ = _payloads(spark, sf_dir)
    return live.live_events(read, names).select("game_id", "event_id", "t_ms", "kind", "killer", "victim", F.size("assists").alias("n_assists"))


@query(f"""with {_NAMES} select w.game_id, n.pid participant_id, w.game_id * 1500.0::double t_ms, cast(cs % 18 + 1 as integer) "level", case when kills > 0 then cast(kills as integer) end kills, case when kills > 0 then cast(cs as integer) end cs, 2 item_count, deaths > 2 is_dead from who w join names n on n.game_id = w.game_id and n.nm = w.nm""")
def p18_live_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    read, names, _ = _payloads(spark, sf_dir)
    return live.live_samples(read, names).select("game_id", "participant_id", "t_ms", "level", "kills", "cs", "item_count", "is_dead")


@query(f"""with {_NAMES}, me as (select game_id, nm from who where participant_id = 4), f as (select w.game_id, min(w.participant_id) k from who w join me m on m.game_id = w.game_id and m.nm = w.nm group by 1), s as (select game_id, round(least(10, count(*) filter (kills > 0)) / 10, 4) completeness from who group by 1)
select game_id, completeness, 'C' || champion champion from s join f using (game_id) join participants p on p.game_id = s.game_id and p.participant_id = f.k""")
def p20_j29_completeness_and_local_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir)[0].select("game_id", live.payload_completeness().alias("completeness"), live.local_player()["championName"].alias("champion")).where("champion is not null")


@query(f"""with {_NAMES}, price as (select p_partkey k, cast(floor(p_retailprice) as bigint) g from part), held as (select game_id, team_id, champion + 1 k from who union all select game_id, team_id, participant_id + 30 from who),
t as (select game_id, coalesce(sum(g) filter (team_id = 100), 0)::bigint order_gold, coalesce(sum(g) filter (team_id = 200), 0)::bigint chaos_gold from held left join price using (k) group by 1)
select cast(game_id as varchar) session_id, order_gold, chaos_gold, order_gold - chaos_gold difference from t""")
def t11_team_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.floor("p_retailprice").cast("long").alias("price"))
    return live.team_gold(_payloads(spark, sf_dir)[0], prices).drop("game_time")


@query(f"""with s as ({SQL["m1_score_composite"]}), g as (select o_orderkey // 10 game_id from orders group by 1 having count(*) = 10) select game_id, participant_id, total_score, match_rank from s join g using (game_id) where game_id > 0 and game_id % 5 > 0 and game_id % 7 > 0""")
def t12_post_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client documents that arrive in a landing folder, scored batch by batch."""
    source = spark.readStream.schema(dc.CLIENT).option("maxFilesPerTrigger", 4).json(client_path(spark, sf_dir))
    score = lambda batch: score_composite(dc.normalise_client(batch)).select("game_id", "participant_id", "total_score", "match_rank")
    rows = live.ingest_stream(source, score, "post-game")
    return rows.withColumn("total_score", F.round("total_score", 6))


@query("select user_id session_id, max(event_id) last_event_id, count(*) events from events group by user_id")
def t8_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return live.progress(e).select("session_id", "last_event_id", "events")


def capture_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls: errors are misses, sign-ups could not be stored, views brought nothing, every seventh is asked to stop."""
    e = _polls(spark, sf_dir)
    kind = F.col("kind")
    return e.select("session_id", "ts", (kind != "error").alias("reachable"), (kind != "signup").alias("stored"), kind.isin("click", "purchase").cast("int").alias("events"), (kind == "purchase").alias("snapshot"), (F.col("event_id") % 7 == 0).alias("stop"))


_MISSES, _SILENCE = 2, 43_200


@query(f"""with p as (select user_id session_id, epoch_us(ts) t, event_type kind, event_id % 7 = 0 stop from events),
a as (select *, case when lag(stop) over w or t - lag(t) over w > {_SILENCE * 1_000_000} or lag(t) over w is null then 1 else 0 end new from p window w as (partition by session_id order by t)),
b as (select *, sum(new) over (partition by session_id order by t rows unbounded preceding) seg from a),
c as (select *, sum((kind <> 'error')::int) over (partition by session_id, seg order by t rows unbounded preceding) grp from b),
d as (select *, case when kind = 'error' then row_number() over (partition by session_id, seg, grp, kind = 'error' order by t) else 0 end k from c),
f as (select *, kind = 'error' and k % {_MISSES} = 0 lost from d),
g as (select *, coalesce(sum(lost::int) over (partition by session_id, seg order by t rows between unbounded preceding and 1 preceding), 0) run from f),
h as (select session_id, min(t) started, max(t) ended, count(*) polls, count(*) filter (kind in ('click', 'purchase')) events, count(*) filter (kind = 'purchase') snapshots, count(*) filter (kind = 'signup') store_errors, arg_max(stop, t) stopped, arg_max(lost, t) lost from g group by session_id, seg, run)
select session_id, started, ended, case when not stopped and not lost then 'partial_process_restart' when events + snapshots = 0 then case when store_errors > 0 then 'partial_storage_errors' else 'partial_no_data' end
  when lost then 'partial_endpoint_lost' when store_errors > 0 then 'partial_storage_errors' else 'completed' end status, polls, events, snapshots, store_errors from h""")
def t5_t6_capture_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state machine with timers, the table landing in order of time."""
    landed = _landed(spark, capture_polls(spark, sf_dir), 3)
    return capture.run_lifecycle(landed, max_misses=_MISSES, silence=_SILENCE)
