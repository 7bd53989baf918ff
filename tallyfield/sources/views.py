"""Match-shaped views over the given tables; amounts are whole numbers (cents), so that sums and ties are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.operators.order_statistics import following
from tallyfield.session import table

ROLES = ("top", "jungle", "mid", "bot", "support")


def role_of(pid: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in ROLES]), ((pid - 1) % 5 + 1).cast("int"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows per game: an order is a participant, its lines are what it did; an order without lines did nothing."""
    lines = table(spark, sf_dir, "lineitem")
    cents = lambda x, by=100: F.round(x * by).cast("long")
    price, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    of = lambda c, v, x: F.sum(F.when(F.col(c) == v, x).otherwise(0))
    did = lines.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("kills"),
        F.count_if(F.col("l_returnflag") == "A").alias("assists"),
        F.count_if(F.col("l_returnflag") == "N").alias("deaths"),
        F.sum(cents(price)).alias("gold_earned"),
        F.sum(F.col("l_quantity").cast("long")).alias("cs"),
        F.sum(cents(net)).alias("damage_to_champions"),
        of("l_linestatus", "O", cents(net)).alias("damage_to_objectives"),
        of("l_linestatus", "F", cents(net)).alias("damage_to_turrets"),
        F.sum("l_linenumber").alias("vision_score"),
        F.count_if(F.col("l_linenumber") % 2 == 0).alias("wards_placed"),
        F.count_if(F.col("l_linenumber") % 2 == 1).alias("wards_killed"),
        F.sum(cents(F.col("l_tax") * price)).alias("damage_mitigated"),
        F.sum(cents(F.col("l_discount"))).alias("healing"),
    )
    key = F.col("o_orderkey")
    pid = (key % 10 + 1).cast("int")
    game = F.floor(key / 10).cast("long")
    team = F.when(pid <= 5, 100).otherwise(200)
    base = table(spark, sf_dir, "orders").select(key.alias("l_orderkey"), game.alias("game_id"), pid.alias("participant_id"), team.alias("team_id"), role_of(pid).alias("role"), (F.col("o_custkey") % 25).cast("int").alias("champion"), F.col("o_custkey").alias("puuid"), (game % 2 == F.when(team == 100, 0).otherwise(1)).alias("win"))
    stats = [c for c in did.columns if c != "l_orderkey"]
    return base.join(did, "l_orderkey", "left").select(*[c for c in base.columns if c != "l_orderkey"], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in stats])


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    game = F.floor(F.col("o_orderkey") / 10).cast("long")
    return (
        orders.groupBy(game.alias("game_id"))
        .agg(F.min("o_orderdate").alias("creation"), F.min(F.substring("o_orderpriority", 1, 1).cast("int")).alias("queue"))
        .select("game_id", "creation", "queue", (300 + F.col("game_id") * 37 % 2700).cast("int").alias("duration"), (F.col("game_id") % 10 + 1).cast("int").alias("local_id"), F.when(F.col("game_id") % 2 == 0, 100).otherwise(200).alias("winner"))
    )


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is a game of 36 minutes; actor and target are two of ten participants."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01")).cast("int")
    clock = F.hour("ts").cast("long") * 3600000 + F.minute("ts") * 60000 + F.floor(F.expr("extract(second from ts)") * 1000).cast("long")
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    actor, target = (F.col("user_id") % 10 + 1).cast("int"), (F.col("k") % 10 + 1).cast("int")
    helper = ((F.col("k") + F.col("user_id")) % 10 + 1).cast("int")
    out = e.select(day.alias("game_id"), "event_id", F.floor(clock / 40).cast("long").alias("t_ms"), kind[F.col("event_type")].alias("kind"), actor.alias("killer"), target.alias("victim"), helper.alias("assist"), *_details(), (F.col("event_id") * 7919 % 15000).cast("int").alias("x"), (F.col("event_id") * 104729 % 15000).cast("int").alias("y"), "value")
    own = (F.col("assist") == F.col("killer")) | (F.col("assist") == F.col("victim"))
    return out.where("killer != victim and kind is not null").withColumn("assist", F.when(~own, F.col("assist")))


def _details() -> list[Column]:
    """Monster, building and lane of an event, each for its kind only."""
    of = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    building = F.col("event_type") == "signup"
    return [F.when(F.col("event_type") == "error", of(MONSTERS)).alias("monster_type"), F.when(building, of(BUILDINGS)).alias("building_type"), F.when(building, of(LANES)).alias("lane")]


MONSTERS = ("HORDE", "DRAGON", "RIFTHERALD", "BARON_NASHOR", "ATAKHAN")
BUILDINGS = ("TOWER_BUILDING", "TOWER_BUILDING", "INHIBITOR_BUILDING", "TOWER_BUILDING")
LANES = ("TOP_LANE", "MID_LANE", "BOT_LANE")

# Which event stands for what.
KINDS = {"purchase": "champion_kill", "error": "elite_monster_kill", "signup": "building_kill", "click": "ward_placed", "view": "ward_kill"}


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame per game, participant and minute: gold so far (cents) and the last position, null before the first event."""
    e = timeline_events(spark, sf_dir)
    spine = e.select("game_id").distinct().select("game_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("participant_id")).select("game_id", "participant_id", F.explode(F.sequence(F.lit(1), F.lit(36))).alias("minute"))
    last = F.max(F.struct("t_ms", "event_id", "x", "y"))
    done = e.groupBy("game_id", F.col("killer").alias("participant_id"), F.least(F.lit(36), F.floor(F.col("t_ms") / 60000) + 1).cast("int").alias("minute")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("g"), last.alias("l"))
    so_far = Window.partitionBy("game_id", "participant_id").orderBy("minute")
    full = spine.join(done, ["game_id", "participant_id", "minute"], "left")
    at = F.last("l", True).over(so_far)
    return full.select("game_id", "participant_id", (F.col("minute") * 60000).cast("long").alias("t_ms"), F.coalesce(F.sum("g").over(so_far), F.lit(0)).alias("gold"), at["x"].alias("x"), at["y"].alias("y"))


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents next to each other inside a source: the choice is the better quality, the score the length."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", "lang", "doc_id", "quality", "toxic", "n_chars")
    p = following(d, "doc_id", F.struct("doc_id", "quality", "n_chars"), "source", name="r").where("r is not null")
    choice = F.when(F.col("quality") > F.col("r.quality"), "left").when(F.col("quality") < F.col("r.quality"), "right").otherwise("tie")
    prob = F.col("n_chars") / (F.col("n_chars") + F.col("r.n_chars"))
    return p.select("source", "lang", F.col("doc_id").alias("left_ref"), F.col("r.doc_id").alias("right_ref"), choice.alias("choice"), F.col("n_chars").alias("left_score"), F.col("r.n_chars").alias("right_score"), prob.alias("p"))


def player_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games and the players in them, every order one edge."""
    return table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 10).cast("long").alias("game_id"), F.col("o_custkey").alias("puuid"))
