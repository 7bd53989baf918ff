"""Structured Streaming over live captures: deduplicated events, throttled snapshots, progress and timers.

A capture repeats all events so far in every poll. ``session_id``, ``event_id`` identify an event; ``ts`` is its time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.session import scratch

LATENESS = "10 minutes"


def extract_events(polls: DataFrame, events: str = "events") -> DataFrame:
    """One row per event of every poll: (session_id, *event fields)."""
    return polls.select("session_id", F.explode(events).alias("e")).select("session_id", "e.*")


def exactly_once(events: DataFrame, keys: tuple[str, ...] = ("session_id", "event_id"), time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Each event once, whatever the number of polls that repeat it within the lateness."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def throttled(snapshots: DataFrame, seconds: int = 15, time: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """The first snapshot of every wall-clock window of ``seconds`` per session."""
    w = F.window(time, f"{seconds} seconds")
    first = F.min_by(F.struct(*snapshots.columns), F.col(time))
    return snapshots.withWatermark(time, lateness).groupBy("session_id", w).agg(first.alias("s")).select("s.*")


def progress(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Last event id and time and the number of events per session, for update mode."""
    return events.withWatermark("ts", lateness).groupBy("session_id").agg(F.max("event_id").alias("last_event_id"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))


def sessions(events: DataFrame, gap: str = "12 minutes 30 seconds", lateness: str = LATENESS) -> DataFrame:
    """Activity of a session between silences of ``gap``; status from what was seen."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", lateness).groupBy("session_id", w).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "GameEnd").alias("ended"))
    status = F.when(F.col("ended") > 0, "completed").when(F.col("events") > 0, "partial_silence").otherwise("partial_empty")
    return out.select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", status.alias("status"))


def changed_only(snapshots: DataFrame, key: str = "session_id", digest: str = "hash", time: str = "ts", idle_ms: int | None = None) -> DataFrame:
    """Stream: snapshots whose hash differs from the one before in the same session, by per-key state.

    ``idle_ms`` of silence end a session's state; a stream that runs over what is there and stops takes None.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in snapshots.schema.fields)

    def keep(key_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the session is silent
            state.remove()
            return
        last = state.get[0] if state.exists else None
        pdf = pd.concat([b for b in batches if len(b)]).sort_values(time)  # a session's snapshots of one trigger, in any number of batches
        before = pdf[digest].shift(1)
        before.iloc[0] = last
        yield pdf[pdf[digest] != before]
        state.update((pdf[digest].iloc[-1],))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return snapshots.groupBy(key).applyInPandasWithState(keep, fields, "last string", "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def changed_only_batch(snapshots: DataFrame, key: str = "session_id", digest: str = "hash", time: str = "ts") -> DataFrame:
    """The same over a table."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(time))
    return snapshots.withColumn("__b", before).where(~F.col(digest).eqNullSafe(F.col("__b"))).drop("__b")


def run_changed(snapshots: DataFrame, name: str, key: str = "session_id", digest: str = "hash", time: str = "ts") -> DataFrame:
    """The same over what a source has now, trigger by trigger with DataFrame functions only, in the shared folder.

    The last hash of every session is a table of two folders in turn: a trigger reads the one of the trigger before and writes the
    other, so a trigger that is repeated reads the same and replaces what it wrote. No session is forgotten.
    """
    spark, path = snapshots.sparkSession, scratch(snapshots.sparkSession, name)
    last = lambda number: f"{path}-state/last/{number % 2}"
    empty = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in snapshots.schema])
    empty.write.parquet(f"{path}/batch=-1")
    empty.select(key, digest).write.parquet(last(-1))

    def step(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.schema(empty.select(key, digest).schema).parquet(last(number - 1)).withColumn("__new", F.lit(False))
        both = batch.withColumn("__new", F.lit(True)).unionByName(known, allowMissingColumns=True)
        before = F.lag(digest).over(Window.partitionBy(key).orderBy("__new", time, digest))
        changed = both.withColumn("__b", before).where(F.col("__new") & ~F.col(digest).eqNullSafe(F.col("__b")))
        changed.select(*snapshots.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        newest = both.groupBy(key).agg(F.max(F.struct("__new", time, digest)).alias("l"))
        newest.select(key, f"l.{digest}").write.mode("overwrite").parquet(last(number))

    snapshots.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}-state/query").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(snapshots.schema).parquet(path).drop("batch")


def reconcile(sessions_: DataFrame, games: DataFrame) -> DataFrame:
    """Sessions with the status of their game id against the known one: null or equal is reconciled, else a mismatch."""
    j = sessions_.join(games.select("session_id", F.col("game_id").alias("known")), "session_id", "left")
    status = F.when(F.col("known").isNull(), "open").when(F.col("game_id").isNull() | (F.col("game_id") == F.col("known")), "reconciled").otherwise("mismatch")
    return j.withColumn("reconciliation", status).withColumn("game_id", F.coalesce("game_id", "known")).drop("known")


def recover_stale(sessions_: DataFrame, now: Column, seconds: int = 750) -> DataFrame:
    """Sessions still called active whose last update is older than ``seconds`` become partial_process_restart."""
    stale = (F.col("status") == "active") & (F.coalesce(F.unix_timestamp("updated_at"), F.lit(0)) + seconds < F.unix_timestamp(now))
    return sessions_.withColumn("status", F.when(stale, "partial_process_restart").otherwise(F.col("status")))


# Seconds of first spawn, of respawn, and from when on an objective does not come again.
TIMERS = (("dragon", 300, 300, None), ("baron", 1500, 360, None), ("herald", 960, 360, 1500), ("grubs", 480, 240, 960))


def objective_timers(kills: DataFrame, now: Column, timers: tuple = TIMERS) -> DataFrame:
    """State of each objective per session: its last kill plus the respawn time, else its first spawn."""
    row = lambda t: F.struct(F.lit(t[0]).alias("objective"), F.lit(t[1]).alias("spawn"), F.lit(t[2]).alias("respawn"), F.lit(t[3]).cast("int").alias("gone_after"))
    last = kills.groupBy("session_id").agg(*[F.max(F.when(F.col("objective") == t[0], F.col("t"))).alias(t[0]) for t in timers])
    killed = F.coalesce(*[F.when(F.col("x.objective") == t[0], F.col(t[0])) for t in timers])
    d = last.withColumn("x", F.explode(F.array(*[row(t) for t in timers]))).select("session_id", "x.*", killed.alias("killed"))
    due = F.coalesce(F.col("killed") + F.col("respawn"), F.col("spawn"))
    state = F.when(F.col("gone_after").isNotNull() & (due > F.col("gone_after")), "gone").when(due <= now, "alive").when(F.col("killed").isNull(), "pending").otherwise("respawning")
    return d.select("session_id", "objective", due.alias("due"), state.alias("state"))


PAYLOAD = (
    "session_id string, game_id long, activePlayer struct<riotId: string, summonerName: string, level: int>, allPlayers array<struct<championName: string, summonerName: string, riotId: string, riotIdGameName: string, riotIdTagLine: string, "
    "team: string, position: string, level: int, isDead: boolean, respawnTimer: double, items: array<struct<itemID: int, price: int>>, scores: struct<kills: int, deaths: int, assists: int, creepScore: int, wardScore: double>>>, "
    "events struct<Events: array<struct<EventID: int, EventName: string, EventTime: double, KillerName: string, VictimName: string, Assisters: array<string>, DragonType: string>>>, gameData struct<gameTime: double, gameMode: string>"
)

# Events of a payload and what they stand for.
MONSTERS = {"DragonKill": "DRAGON", "HeraldKill": "RIFTHERALD", "BaronKill": "BARON_NASHOR", "HordeKill": "HORDE", "AtakhanKill": "ATAKHAN"}
BUILDINGS = {"TurretKilled": "TOWER_BUILDING", "InhibKilled": "INHIBITOR_BUILDING"}


def payload_problem() -> Column:
    """What a payload lacks, null if nothing: the active player, players with a champion, an event list, the game's time."""
    return (
        F.when(F.col("activePlayer").isNull(), "active_player")
        .when(F.coalesce(F.size("allPlayers"), F.lit(0)) < 1, "players")
        .when(F.exists("allPlayers", lambda p: F.coalesce(p["championName"], F.lit("")) == ""), "player_entry")
        .when(F.col("events.Events").isNull(), "events")
        .when(F.col("gameData.gameTime").isNull(), "game_time")
    )


def payload_completeness() -> Column:
    """The share of ten players that have scores."""
    usable = F.size(F.filter(F.coalesce("allPlayers", F.array()), lambda p: p["scores"].isNotNull()))
    return F.round(F.least(usable, F.lit(10)) / 10, 4)


def name_map(payloads: DataFrame, participants: DataFrame) -> DataFrame:
    """(game_id, names): a map from display names to participants of whom the champion is the only one in the match.

    A player has up to four names. A name that several participants carry goes to the smallest id.
    """
    single = participants.groupBy("game_id", F.col("champion_name").alias("c")).agg(F.min("participant_id").alias("participant_id"), F.count("*").alias("n")).where("n = 1")
    players = payloads.select("game_id", F.explode("allPlayers").alias("p"))
    tagged = F.when((F.col("p.riotIdGameName") != "") & (F.col("p.riotIdTagLine") != ""), F.concat_ws("#", "p.riotIdGameName", "p.riotIdTagLine"))
    names = players.select("game_id", F.col("p.championName").alias("c"), F.explode(F.array_compact(F.array("p.summonerName", "p.riotId", "p.riotIdGameName", tagged))).alias("name")).where("name != ''")
    known = names.join(single, ["game_id", "c"]).groupBy("game_id", "name").agg(F.min("participant_id").alias("participant_id"))
    return known.groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "participant_id"))).alias("names"))


def live_events(payloads: DataFrame, names: DataFrame) -> DataFrame:
    """(game_id, event_id, t_ms, kind, killer, victim, assists, monster_type, building_type): known events once, unknown names null."""
    e = payloads.select("game_id", F.explode("events.Events").alias("e")).where("e.EventTime is not null")
    one = e.groupBy("game_id", F.col("e.EventID").alias("event_id")).agg(F.min_by("e", "e.EventTime").alias("e")).join(names, "game_id", "left")
    of = lambda x: F.try_element_at("names", x)
    table = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("e.EventName")]
    monster, building = table(MONSTERS), table(BUILDINGS)
    kind = F.when(F.col("e.EventName") == "ChampionKill", "champion_kill").when(building.isNotNull(), "building_kill").when(monster.isNotNull(), "elite_monster_kill")
    kill = F.col("e.EventName") == "ChampionKill"
    helped = F.when(kill, F.array_compact(F.transform("e.Assisters", of)))
    return one.select("game_id", "event_id", (F.col("e.EventTime") * 1000).alias("t_ms"), kind.alias("kind"), of(F.col("e.KillerName")).alias("killer"), F.when(kill, of(F.col("e.VictimName"))).alias("victim"), F.coalesce(helped, F.array().cast("array<int>")).alias("assists"), monster.alias("monster_type"), building.alias("building_type")).where("kind is not null")


def live_samples(payloads: DataFrame, names: DataFrame) -> DataFrame:
    """A row per payload and known player with what is comparable for all ten; the active player's own fields are not read."""
    p = payloads.where("gameData.gameTime is not null").select("game_id", (F.col("gameData.gameTime") * 1000).alias("t_ms"), F.explode("allPlayers").alias("p")).join(names, "game_id")
    pid = F.coalesce(*[F.try_element_at("names", F.col(f"p.{c}")) for c in ("summonerName", "riotId", "riotIdGameName")])
    s = F.col("p.scores")
    return p.select("game_id", pid.alias("participant_id"), "t_ms", F.col("p.level").alias("level"), s["kills"].alias("kills"), s["deaths"].alias("deaths"), s["assists"].alias("assists"), s["creepScore"].alias("cs"), F.coalesce(F.size("p.items"), F.lit(0)).alias("item_count"), F.coalesce("p.isDead", F.lit(False)).alias("is_dead"), F.col("p.respawnTimer").alias("respawn_timer")).where("participant_id is not null")


def local_player() -> Column:
    """The payload's own player: by full id over all players first, else by the old name; case and blanks at the ends do not count."""
    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))

    def full(p: Column) -> Column:
        own = plain(p["riotId"])
        name, tag = F.trim(F.coalesce(p["riotIdGameName"], F.lit(""))), F.trim(F.coalesce(p["riotIdTagLine"], F.lit("")))
        return F.when(own != "", own).when((name != "") & (tag != ""), F.lower(F.concat_ws("#", name, tag))).otherwise("")

    wanted, old = plain(F.col("activePlayer.riotId")), plain(F.col("activePlayer.summonerName"))
    first = F.get(F.filter("allPlayers", lambda p: (wanted != "") & (full(p) == wanted)), F.lit(0))
    second = F.get(F.filter("allPlayers", lambda p: (old != "") & (plain(p["summonerName"]) == old)), F.lit(0))
    return F.coalesce(first, second)


def team_gold(payloads: DataFrame, prices: DataFrame) -> DataFrame:
    """(session_id, game_time, order_gold, chaos_gold, difference): what the held items of both teams cost."""
    held = payloads.select("session_id", F.col("gameData.gameTime").alias("game_time"), F.explode("allPlayers").alias("p"))
    each = held.select("session_id", "game_time", F.upper("p.team").alias("team"), F.explode_outer(F.transform("p.items", lambda i: i["itemID"])).alias("item_id"))
    g = each.join(prices.select("item_id", "price"), "item_id", "left").groupBy("session_id", "game_time").agg(*[F.sum(F.when(F.col("team") == t, F.coalesce("price", F.lit(0))).otherwise(0)).alias(f"{t.lower()}_gold") for t in ("ORDER", "CHAOS")])
    return g.withColumn("difference", F.col("order_gold") - F.col("chaos_gold"))


def ingest_stream(documents: DataFrame, transform, name: str) -> DataFrame:
    """Runs ``transform`` over every batch of arriving documents; a batch that is repeated replaces what it wrote."""
    spark = documents.sparkSession
    path = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    documents.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("batch")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now into Parquet in the shared folder, and reads that."""
    spark: SparkSession = stream.sparkSession
    path = scratch(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
