"""Client documents, consistency between documents, dimensions, manifests and scans of what must not leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.sources.ingest import QUEUES, display_name, epoch

_STATS = {"kills": "kills", "deaths": "deaths", "assists": "assists", "gold_earned": "goldEarned", "champion_level": "champLevel", "assists": "assists", "damage_to_champions": "totalDamageDealtToChampions", "damage_to_objectives": "damageDealtToObjectives", "damage_to_turrets": "damageDealtToTurrets", "damage_taken": "totalDamageTaken", "damage_mitigated": "damageSelfMitigated", "healing": "totalHeal", "vision_score": "visionScore", "wards_placed": "wardsPlaced", "wards_killed": "wardsKilled"}
_LONG, _TEXT = T.LongType(), T.StringType()
CLIENT = T.StructType([
    *[T.StructField(n, _LONG) for n in ("gameId", "queueId", "mapId", "gameDuration", "gameCreation")],
    T.StructField("gameMode", _TEXT), T.StructField("gameVersion", _TEXT),
    T.StructField("participantIdentities", T.ArrayType(T.StructType([T.StructField("participantId", _LONG), T.StructField("player", T.StructType([T.StructField(n, _TEXT) for n in ("puuid", "gameName", "tagLine", "summonerName")]))]))),
    T.StructField("participants", T.ArrayType(T.StructType([
        *[T.StructField(n, _LONG) for n in ("participantId", "championId", "teamId")],
        T.StructField("timeline", T.StructType([T.StructField("lane", _TEXT), T.StructField("role", _TEXT)])),
        T.StructField("stats", T.StructType([*[T.StructField(n, _LONG) for n in (*_STATS.values(), "totalMinionsKilled", "neutralMinionsKilled", *[f"item{i}" for i in range(7)])], T.StructField("win", T.BooleanType()), T.StructField("gameEndedInEarlySurrender", T.BooleanType())])),
    ]))),
])


def lane_role(lane: Column, role: Column) -> Column:
    """The role that a lane and its share give; empty where they do not tell."""
    lane, role = F.upper(F.coalesce(lane, F.lit(""))), F.upper(F.coalesce(role, F.lit("")))
    alone = role != "DUO"
    bottom = F.when(role.contains("SUPPORT"), "support").when(role.contains("CARRY"), "bot").otherwise("")
    return F.when(lane == "JUNGLE", "jungle").when((lane == "TOP") & alone, "top").when((lane == "MIDDLE") & alone, "mid").when(lane == "BOTTOM", bottom).otherwise("")


def client_rejection(docs: DataFrame) -> DataFrame:
    """Adds ``reason``: the first rule that a client document breaks, null if it is eligible."""
    early = F.exists("participants", lambda p: F.coalesce(p["stats"]["gameEndedInEarlySurrender"], F.lit(False)))
    reason = (
        F.when(F.coalesce("gameId", F.lit(0)) <= 0, "no_id")
        .when(~F.coalesce(F.col("queueId").isin(*QUEUES), F.lit(False)) | (F.coalesce("mapId", F.lit(0)) != 11), "queue_or_map")
        .when(F.coalesce(F.size("participants"), F.lit(0)) != 10, "participant_count")
        .when((F.coalesce("gameDuration", F.lit(0)) < 300) | early, "remake")
    )
    return docs.withColumn("reason", reason)


def normalise_client(docs: DataFrame) -> DataFrame:
    """Ten typed rows per eligible client document; identities are looked up inside the document, missing numbers are 0."""
    d = client_rejection(docs).where("reason is null")
    p, s = F.col("p"), F.col("p.stats")
    identity = F.get(F.filter("participantIdentities", lambda i: i["participantId"] == p["participantId"]), F.lit(0))["player"]
    n = lambda x: F.coalesce(x, F.lit(0))
    items = F.filter(F.array(*[n(s[f"item{i}"]) for i in range(7)]), lambda x: x > 0)
    rows = d.select("*", F.explode("participants").alias("p"))
    return rows.select(
        F.col("gameId").alias("game_id"), p["participantId"].cast("int").alias("participant_id"), F.coalesce(identity["puuid"], F.lit("")).alias("puuid"),
        display_name(identity["gameName"], identity["tagLine"], identity["summonerName"], p["participantId"]).alias("name"),
        p["championId"].cast("int").alias("champion_id"), p["teamId"].cast("int").alias("team_id"), lane_role(p["timeline"]["lane"], p["timeline"]["role"]).alias("role"), F.coalesce(s["win"], F.lit(False)).alias("win"),
        *[n(s[c]).alias(a) for a, c in _STATS.items()], (n(s["totalMinionsKilled"]) + n(s["neutralMinionsKilled"])).alias("cs"), items.alias("items"), epoch(F.col("gameCreation")).alias("creation"), F.col("gameDuration").cast("int").alias("duration"),
    )


def same_players(left: DataFrame, right: DataFrame, key: str = "match_id", player: str = "puuid") -> DataFrame:
    """(key, status): equal, different, or missing on a side, by the sorted distinct players of both."""
    sets = lambda df, name: df.where(F.col(player).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(player)).alias(name))
    both = sets(left, "a").join(sets(right, "b"), key, "full")
    return both.select(key, F.when(F.col("a").isNull(), "missing_left").when(F.col("b").isNull(), "missing_right").when(F.col("a") == F.col("b"), "equal").otherwise("different").alias("status"))


def known_participants(frames: DataFrame, players: DataFrame, key: str = "match_id") -> DataFrame:
    """(key, unknown): how many participants of a match's frames are not among its players."""
    seen = frames.select(key, "participant_id").distinct()
    listed = players.select(key, "participant_id", F.lit(1).alias("__known")).distinct()
    return seen.join(listed, [key, "participant_id"], "left").groupBy(key).agg(F.count_if(F.col("__known").isNull()).alias("unknown"))


def duration_bucket(seconds: Column, minutes: tuple[int, ...] = (10, 25, 40)) -> Column:
    """under_10m, 10_25m, ..., 40m_plus; null stays null."""
    out, low = F.when(seconds < minutes[0] * 60, f"under_{minutes[0]}m"), minutes[0]
    for high in minutes[1:]:
        out, low = out.when(seconds < high * 60, f"{low}_{high}m"), high
    return out.when(seconds.isNotNull(), f"{low}m_plus")


REVIEW = "label_id string, pair_id string, reviewer_id string, choice string, confidence double, rationale_tags array<string>, notes string, created_at string"


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, one row with the number of lines that do not parse) of review labels as JSON lines."""
    raw = spark.read.schema(f"{REVIEW}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("label_id").isNull()
    return raw.where(~bad).drop("_corrupt"), raw.agg(F.count_if(bad).alias("skipped"), F.count_if(~bad).alias("kept"))


def only_listed(rows: DataFrame, path: str, key: str = "game_id") -> DataFrame:
    """Rows whose key is in a text file of one id a line; blank lines and what is no number are ignored."""
    ids = rows.sparkSession.read.text(path).select(F.trim("value").try_cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    return rows.join(ids, key, "left_semi")


ITEM = "struct<name: string, tags: array<string>, gold: struct<total: int, purchasable: boolean>, stats: map<string, double>, maps: map<string, boolean>, `from`: array<string>>"


def items(catalogue: DataFrame) -> DataFrame:
    """(item_id, name, gold, armor, mr, hp, tags, depth, sr) of the purchasable items of a catalogue, a map ``data`` by id."""
    rows = catalogue.select(F.explode("data").alias("k", "i")).withColumn("item_id", F.col("k").try_cast("int")).where("item_id is not null and coalesce(i.gold.purchasable, true)")
    stat = lambda name: F.coalesce(F.try_element_at("i.stats", F.lit(name)), F.lit(0.0)).cast("int")
    rift = F.coalesce(F.try_element_at("i.maps", F.lit("11")), F.lit(False)) & (F.col("item_id") < 100_000)
    return rows.select("item_id", F.col("i.name").alias("name"), F.coalesce("i.gold.total", F.lit(0)).alias("gold"), stat("FlatArmorMod").alias("armor"), stat("FlatSpellBlockMod").alias("mr"), stat("FlatHPPoolMod").alias("hp"), F.coalesce("i.tags", F.array().cast("array<string>")).alias("tags"), F.greatest(F.lit(0), F.size(F.coalesce("i.from", F.array().cast("array<string>")))).alias("depth"), rift.alias("sr"))


def champions(catalogue: DataFrame, melee: int = 350) -> DataFrame:
    """(name, tags, attack_range, range_type) of a catalogue's named champions."""
    rows = catalogue.select(F.explode(F.map_values("data")).alias("c")).where("c.name != ''")
    reach = F.coalesce(F.col("c.stats.attackrange").cast("int"), F.lit(0))
    return rows.select("c.name", F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"), reach.alias("attack_range"), F.when((reach > 0) & (reach <= melee), "melee").otherwise("ranged").alias("range_type"))


# Capability flags, and those that each evidence tier has by default.
FLAGS = ("has_all_player_parity", "has_local_player_detail", "has_position_timeline", "has_minute_frames", "has_subminute_resolution", "has_champion_events", "has_building_events", "has_item_events", "has_ward_events", "has_victim_damage_detail", "has_bounty_detail")
TIER_FLAGS = {
    "match_v5": tuple(f for f in FLAGS if f != "has_subminute_resolution"),
    "lcu_timeline": ("has_all_player_parity", "has_local_player_detail", "has_position_timeline", "has_minute_frames", "has_champion_events", "has_building_events"),
    "live_client": ("has_local_player_detail", "has_subminute_resolution"),
    "aggregate": ("has_all_player_parity", "has_local_player_detail"),
}
PRIVACY = ("local_hashed_real", "local_hashed_synthetic")
CONSENT = ("personal_local_client_data", "match_v5_personal_key_research_only", "match_v5_authorization_blocked", "synthetic_no_consent_required", "unknown")
SECRET_KEYS = ("api_key", "apikey", "secret", "token", "password", "credential", "riot_key", "puuid", "summoner_name", "account_id")
SECRET_VALUE = "RGAPI-[0-9a-fA-F-]{20,}"
RAW_ID = "^[A-Za-z0-9_-]{70,}$"
JUDGE_KEYS = ("match_rank", "rank_confidence", "participant_confidence", "score_model_version", "score_version", "placement", "mvp")  # and all that end in _score
REFERENCE_KEYS = ("participant_id", "lane_opponent", "killer", "victim")
PRESENTED = ("champion_name", "role", "champion_level", "kills", "deaths", "assists", "gold_earned", "cs", "damage_to_champions", "damage_to_objectives", "damage_to_turrets", "damage_taken", "damage_mitigated", "healing", "vision_score", "wards_placed", "wards_killed", "duration_seconds", "patch")


def manifest_entries(facts: DataFrame, overrides: str | None = None) -> DataFrame:
    """(entry_id, game_id, source, content_hash, completeness, capability_flags, ...) of facts with (game_id, source, payload).

    Flags are the tier's, replaced by those of the map ``overrides``; completeness is clamped to 0..1.
    """
    defaults = F.lit(None).cast("map<string,boolean>")
    for tier, has in TIER_FLAGS.items():
        defaults = F.when(F.col("source") == tier, F.create_map(*[x for f in FLAGS for x in (F.lit(f), F.lit(f in has))])).otherwise(defaults)
    own = F.coalesce(F.col(overrides), F.create_map().cast("map<string,boolean>")) if overrides else None
    flags = defaults if own is None else F.transform_values(defaults, lambda k, v: F.coalesce(F.try_element_at(own, k), v))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("completeness").cast("double"), F.lit(0.0))))
    rest = [c for c in facts.columns if c not in ("completeness", "payload", overrides)]
    return facts.select(F.concat_ws(":", "game_id", "source").alias("entry_id"), *rest, F.sha2("payload", 256).alias("content_hash"), share.alias("completeness"), flags.alias("capability_flags"))


def manifest_problems(entries: DataFrame) -> DataFrame:
    """(entry_id, problem): every rule that an entry breaks, and ids with several hashes."""
    names = F.array_sort(F.array(*[F.lit(f) for f in FLAGS]))
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    rules = {
        "source": known("source", TIER_FLAGS),
        "privacy_classification": known("privacy_classification", PRIVACY),
        "consent_status": known("consent_status", CONSENT),
        "completeness": F.coalesce(F.col("completeness").between(0, 1), F.lit(False)),
        "capability_flags": F.coalesce(F.array_sort(F.map_keys("capability_flags")) == names, F.lit(False)) & F.forall(F.map_values("capability_flags"), lambda v: v.isNotNull()),
        "game_id": F.coalesce(F.col("game_id") > 0, F.lit(False)),
        "player_group_keys": F.coalesce(F.size("player_group_keys") > 0, F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    single = entries.select("entry_id", F.explode(broken).alias("problem"))
    several = entries.groupBy("entry_id").agg(F.count_distinct("content_hash").alias("n")).where("n > 1").select("entry_id", F.lit("content_hash").alias("problem"))
    return single.unionByName(several)


def manifest_stats(entries: DataFrame, by: str = "source") -> DataFrame:
    """Entries and mean completeness (4 digits) by source or another column."""
    return entries.groupBy(by).agg(F.count("*").alias("entries"), F.round(F.avg("completeness"), 4).alias("mean_completeness"))


def write_manifest(entries: DataFrame, path: str) -> None:
    """JSON lines in the order of the entry's id."""
    entries.orderBy("entry_id").write.json(path)


def secrets(rows: DataFrame, json: str, key: str) -> DataFrame:
    """(key, problem): forbidden parts of key names, developer keys, and long values that are no hash, at any depth of a JSON text."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(F.col(json), F.lit(r'"([^"\\]+)"\s*:'), 1), lambda k: F.lower(k)))
    values = F.regexp_extract_all(F.col(json), F.lit(r'"([^"\\]*)"\s*(?=[,}\]])'), 1)
    bad = F.filter(names, lambda k: k.rlike("|".join(SECRET_KEYS)))
    keys = F.transform(F.filter(values, lambda v: v.rlike(SECRET_VALUE)), lambda v: F.lit("developer_key"))
    ids = F.transform(F.filter(values, lambda v: ~v.rlike(SECRET_VALUE) & v.rlike(RAW_ID) & ~v.rlike("^[0-9a-f]+$")), lambda v: F.lit("raw_identifier"))
    every = F.array_distinct(F.concat(F.transform(bad, lambda k: F.concat(F.lit("key:"), k)), keys, ids))
    return rows.select(key, F.explode(every).alias("problem"))


def judge_leaks(rows: DataFrame, json: str, key: str) -> DataFrame:
    """(key, field, kind): score and participant-reference keys in a JSON text, whatever their spelling."""
    plain = lambda k: F.regexp_replace(F.regexp_replace(F.lower(k), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    names = F.array_distinct(F.transform(F.regexp_extract_all(F.col(json), F.lit(r'"([^"\\]+)"\s*:'), 1), plain))
    found = rows.select(key, F.explode(names).alias("field"))
    kind = F.when(F.col("field").isin(*JUDGE_KEYS) | F.col("field").endswith("_score"), "score").when(F.col("field").isin(*REFERENCE_KEYS), "reference")
    return found.withColumn("kind", kind).where("kind is not null")


def presented(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys and those of the nineteen presentable fields that there are."""
    return rows.select(*keys, *[c for c in PRESENTED if c in rows.columns])
