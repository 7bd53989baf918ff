"""Reading match, timeline and label documents, and bringing them to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranked and normal queues, roles by position, platform to routing region.
QUEUES = (400, 420, 430, 440, 480, 490)
POSITIONS = {"TOP": "top", "JUNGLE": "jungle", "MIDDLE": "mid", "MID": "mid", "BOTTOM": "bot", "BOT": "bot", "UTILITY": "support", "SUPPORT": "support"}
ROUTES = {"NA1": "americas", "BR1": "americas", "LA1": "americas", "LA2": "americas", "EUW1": "europe", "EUN1": "europe", "TR1": "europe", "RU": "europe", "KR": "asia", "JP1": "asia", "OC1": "sea"}
EVENT_KINDS = {"CHAMPION_KILL": "champion_kill", "BUILDING_KILL": "building_kill", "TURRET_PLATE_DESTROYED": "turret_plate", "ELITE_MONSTER_KILL": "elite_monster_kill", "WARD_PLACED": "ward_placed", "WARD_KILL": "ward_kill"}
STATS = ("kills", "deaths", "assists", "goldEarned", "totalMinionsKilled", "neutralMinionsKilled", "visionScore", "wardsPlaced", "wardsKilled", "champLevel")

_TEXT = T.StringType()
PLAYER = T.StructType([T.StructField(n, _TEXT) for n in ("participantId", "puuid", "teamId", "championId", "championName", "teamPosition", "summonerName", "riotIdGameName", "riotIdTagline", *STATS, *[f"item{i}" for i in range(7)])] + [T.StructField("win", T.BooleanType()), T.StructField("teamEarlySurrendered", T.BooleanType())])
MATCH = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("matchId", _TEXT)])),
    T.StructField("info", T.StructType([T.StructField(n, _TEXT) for n in ("gameId", "queueId", "mapId", "gameDuration", "gameCreation", "gameMode", "gameVersion")] + [T.StructField("participants", T.ArrayType(PLAYER))])),
])
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
EVENT = T.StructType([T.StructField("type", _TEXT), T.StructField("timestamp", T.DoubleType()), *[T.StructField(n, T.IntegerType()) for n in ("killerId", "victimId", "creatorId", "killerTeamId")], T.StructField("assistingParticipantIds", T.ArrayType(T.IntegerType())), *[T.StructField(n, _TEXT) for n in ("buildingType", "laneType", "monsterType")], T.StructField("position", POINT)])
FRAME = T.StructType([T.StructField("timestamp", T.DoubleType()), T.StructField("events", T.ArrayType(EVENT)), T.StructField("participantFrames", T.MapType(_TEXT, T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("participantId", "totalGold", "currentGold", "xp", "level", "minionsKilled", "jungleMinionsKilled")], T.StructField("position", POINT)])))])
TIMELINE = T.StructType([T.StructField("metadata", T.StructType([T.StructField("matchId", _TEXT)])), T.StructField("info", T.StructType([T.StructField("frames", T.ArrayType(FRAME))]))])


def read_documents(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """One row per JSON document; what does not parse is kept as ``_corrupt``."""
    return spark.read.schema(schema.add("_corrupt", "string") if "_corrupt" not in schema.names else schema).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multi_line).json(path)


def number(x: Column) -> Column:
    """A whole number from a plain value or a typed wrapper such as {"$numberLong": "5"}; null for anything else."""
    inner = F.coalesce(*[F.get_json_object(x, f"$['${k}']") for k in ("numberLong", "numberInt", "numberDouble", "numberDecimal")])
    return F.coalesce(x.try_cast("double"), inner.try_cast("double")).try_cast("long")


def epoch(x: Column) -> Column:
    """A timestamp from milliseconds, or from seconds up to 10^10."""
    return F.when(x > 10_000_000_000, F.timestamp_millis(x)).otherwise(F.timestamp_seconds(x))


def display_name(name: Column, tag: Column, old: Column, number_: Column) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(F.when(blank(name).isNotNull() & blank(tag).isNotNull(), F.concat(name, F.lit("#"), tag)), blank(name), blank(old), F.concat(F.lit("Player "), number_.cast("string")))


def role(position: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])[F.upper(position)], F.lit(""))


def match_id(text: Column) -> Column:
    """(platform, game_id, region) of PLATFORM_123; nulls where it does not parse or the platform is unknown."""
    platform, game = F.regexp_extract(text, "^([A-Z0-9]+)_([0-9]+)$", 1), F.regexp_extract(text, "^([A-Z0-9]+)_([0-9]+)$", 2)
    region = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])[platform]
    return F.struct(F.when(region.isNotNull(), platform).alias("platform"), game.try_cast("long").alias("game_id"), region.alias("region"))


def rejection(docs: DataFrame) -> DataFrame:
    """Adds ``reason``: the first rule that a document breaks, null if it is eligible."""
    info, ps = F.col("info"), F.col("info.participants")
    roles = lambda team: F.array_sort(F.transform(F.filter(ps, lambda p: p["teamId"] == team), lambda p: role(p["teamPosition"])))
    want = F.array_sort(F.array(*[F.lit(r) for r in ("top", "jungle", "mid", "bot", "support")]))
    reason = (
        F.when(info.isNull() | ps.isNull(), "unreadable")
        .when(~F.coalesce(number(info["queueId"]).isin(*QUEUES), F.lit(False)), "queue")
        .when(F.coalesce(number(info["mapId"]), F.lit(0)) != 11, "map")
        .when(F.size(ps) != 10, "participant_count")
        .when(F.coalesce(number(info["gameDuration"]), F.lit(0)) < 300, "too_short")
        .when(F.exists(ps, lambda p: F.coalesce(p["teamEarlySurrendered"], F.lit(False))), "early_surrender")
        .when(F.size(F.array_distinct(F.transform(ps, lambda p: p["puuid"]))) != 10, "identity")
        .when((roles("100") != want) | (roles("200") != want), "roles")
    )
    return docs.withColumn("reason", reason)


def tally(docs: DataFrame) -> DataFrame:
    """Documents per reason; accepted ones count as 'accepted'."""
    return docs.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("documents"))


def normalise(docs: DataFrame, salt: str) -> DataFrame:
    """Ten rows per eligible document, with typed numbers and pseudonyms in place of identities."""
    from tallyfield.operators.corpus import pseudonym

    p = rejection(docs).where("reason is null").select("metadata.matchId", "info", F.posexplode("info.participants").alias("at", "p"))
    i, q = F.col("info"), F.col("p")
    n = lambda c: F.coalesce(number(q[c]), F.lit(0))
    items = F.filter(F.array(*[n(f"item{k}") for k in range(7)]), lambda x: x > 0)
    snake = {"kills": "kills", "deaths": "deaths", "assists": "assists", "gold_earned": "goldEarned", "vision_score": "visionScore", "wards_placed": "wardsPlaced", "wards_killed": "wardsKilled", "champion_level": "champLevel"}
    pid = F.coalesce(number(q["participantId"]), F.col("at") + 1).cast("int")
    return p.select(
        F.coalesce(number(i["gameId"]), match_id(F.col("matchId"))["game_id"]).alias("game_id"), pid.alias("participant_id"), pseudonym(q["puuid"], salt).alias("puuid"), F.concat(F.lit("Player "), pid.cast("string")).alias("name"),
        number(q["teamId"]).cast("int").alias("team_id"), role(q["teamPosition"]).alias("role"), number(q["championId"]).cast("int").alias("champion_id"), q["championName"].alias("champion"), F.coalesce(q["win"], F.lit(False)).alias("win"),
        *[n(c).alias(a) for a, c in snake.items()], (n("totalMinionsKilled") + n("neutralMinionsKilled")).alias("cs"), items.alias("items"),
        epoch(number(i["gameCreation"])).alias("creation"), number(i["gameDuration"]).cast("int").alias("duration"), F.substring_index(i["gameVersion"], ".", 2).alias("patch"),
    )


def canonical_events(timelines: DataFrame) -> DataFrame:
    """(match_id, event_order, t_ms, kind, killer, victim, assists, ...); unknown types and ids outside 1-10 are dropped."""
    kind = F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv])
    e = timelines.select(F.col("metadata.matchId").alias("match_id"), F.posexplode(F.flatten(F.transform("info.frames", lambda f: F.coalesce(f["events"], F.array().cast(T.ArrayType(EVENT)))))).alias("event_order", "e"))
    pid = lambda c: F.when(F.col(c).between(1, 10), F.col(c))
    actor = F.coalesce(pid("e.killerId"), pid("e.creatorId"))
    return e.select("match_id", "event_order", F.col("e.timestamp").alias("t_ms"), kind[F.col("e.type")].alias("kind"), actor.alias("killer"), pid("e.victimId").alias("victim"), F.coalesce("e.assistingParticipantIds", F.array().cast("array<int>")).alias("assists"), F.col("e.laneType").alias("lane"), F.col("e.buildingType").alias("building_type"), F.col("e.monsterType").alias("monster_type"), F.col("e.position").alias("position")).where("kind is not null and t_ms is not null")


def canonical_frames(timelines: DataFrame) -> DataFrame:
    """One row per participant and frame; gold is the total, else the current."""
    f = timelines.select(F.col("metadata.matchId").alias("match_id"), F.explode("info.frames").alias("f")).select("match_id", F.col("f.timestamp").alias("t_ms"), F.explode("f.participantFrames").alias("k", "p"))
    return f.select("match_id", F.coalesce("p.participantId", F.col("k").try_cast("int")).alias("participant_id"), "t_ms", F.coalesce("p.totalGold", "p.currentGold").alias("gold"), F.col("p.xp").alias("xp"), F.col("p.level").alias("level"), F.coalesce("p.minionsKilled", F.lit(0)).alias("cs"), F.coalesce("p.jungleMinionsKilled", F.lit(0)).alias("jungle_cs"), F.col("p.position").alias("position"))


def completeness(frames: DataFrame, durations: DataFrame, step_ms: int = 60_000) -> DataFrame:
    """(match_id, completeness, ordered): time covered x frames there x participants there, each at most 1."""
    per = frames.groupBy("match_id", "t_ms").agg(F.count_distinct("participant_id").alias("n"))
    lag = F.lag("t_ms").over(Window.partitionBy("match_id").orderBy("t_ms"))
    agg = per.withColumn("ok", lag.isNull() | (F.col("t_ms") > lag)).groupBy("match_id").agg(F.max("t_ms").alias("last"), F.count("*").alias("frames"), F.sum("n").alias("rows"), F.bool_and("ok").alias("ordered"))
    d = agg.join(durations.select("match_id", (F.col("duration") * 1000.0).alias("ms")), "match_id")
    one = F.lit(1.0)
    due = F.floor(F.col("ms") / step_ms) + 1
    return d.select("match_id", F.round(F.least(one, F.col("last") / F.col("ms")) * F.least(one, F.col("frames") / due) * F.least(one, F.col("rows") / (F.col("frames") * 10)), 4).alias("completeness"), "ordered")


def join_timelines(matches: DataFrame, timelines: DataFrame, known: DataFrame) -> DataFrame:
    """Matches that have a timeline and are not ingested yet: one equi-join and one anti-join, no candidate limit."""
    return matches.join(timelines, "match_id").join(known.select("match_id"), "match_id", "left_anti")
