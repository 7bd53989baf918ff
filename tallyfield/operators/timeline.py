"""Features from event and position timelines: interval joins, as-of lookups and counts per participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Windows in ms and distances in map units.
TRADE_MS = 10_000
CONTEST_MS = 20_000
VISION_MS = 20_000
RAPID_DEATH_MS = 45_000
CONVERSION_MS = 60_000
FRAME_AGE_MS = 60_000
NEAR = 3000
GOLD_LEAD = 300
PHASES = (("early", 0, 840_000), ("mid", 840_000, 1_500_000), ("late", 1_500_000, None))


def phase(t: Column) -> Column:
    """early, mid or late."""
    return F.when(t < PHASES[0][2], "early").when(t < PHASES[1][2], "mid").otherwise("late")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Null when a coordinate is null."""
    return F.hypot((x1 - x2).cast("double"), (y1 - y2).cast("double"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], before: int, after: int, t: str = "t_ms") -> DataFrame:
    """Pairs of rows (structs ``l`` and ``r``) of equal keys with l.t - before <= r.t <= l.t + after.

    Time is cut into buckets as wide as the window; a left row goes to the buckets that its window touches, so the join
    is an equi-join on (keys, bucket) whatever the size of a key, and a residual filter makes it exact.
    """
    width = max(1, before + after)
    bucket = lambda c: F.floor(c / width)
    lo, hi = F.col(t) - before, F.col(t) + after
    a = left.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct("*").alias("l"), F.explode(F.sequence(bucket(lo), bucket(hi))).alias("__b"))
    b = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct("*").alias("r"), bucket(F.col(t)).alias("__b"))
    near = a.join(b, [*[f"__{k}" for k in keys], "__b"])
    return near.where(F.col(f"r.{t}").between(F.col(f"l.{t}") - before, F.col(f"l.{t}") + after)).select("l", "r")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str, max_age: int, name: str = "asof") -> DataFrame:
    """Adds the newest non-null ``value`` of ``right`` at or before each left row, at most ``max_age`` old: one shuffle."""
    stamped = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("at"), F.col(value).alias("v")))
    r = right.select(*keys, F.col(t).alias("__t"), F.lit(0).alias("__side"), stamped.alias("__v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__row"))
    x = left.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), F.struct("*").alias("__row"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = r.union(x).withColumn("__last", F.last("__v", True).over(w)).where("__side = 1")
    fresh = F.when(F.col("__t") - F.col("__last.at") <= max_age, F.col("__last.v"))
    return seen.select("__row.*", fresh.alias(name))


def team_of(pid: Column) -> Column:
    return F.when(pid <= 5, 100).otherwise(200)


def trades(events: DataFrame) -> DataFrame:
    """Per death: traded, untraded or unknown, from the kills of the victim's team within 10 s and 3000 units."""
    kills = events.where("kind = 'champion_kill'")
    near = interval_join(kills, kills, ["game_id"], TRADE_MS, TRADE_MS).where("l.event_id != r.event_id").where(team_of(F.col("r.killer")) == team_of(F.col("l.victim")))
    gap = distance(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y"))
    found = near.groupBy(F.col("l.game_id").alias("game_id"), F.col("l.event_id").alias("event_id")).agg(F.max((gap <= NEAR).cast("int")).alias("close"), F.count("*").alias("n"), F.count(gap).alias("placed"))
    state = F.when(F.col("n").isNull(), "untraded").when(F.col("close") == 1, "traded").when(F.col("placed") == F.col("n"), "untraded").otherwise("unknown")
    return kills.join(found, ["game_id", "event_id"], "left").select("game_id", "event_id", "t_ms", "victim", state.alias("trade"))


def first_blood(events: DataFrame) -> DataFrame:
    """(game_id, killer) of the earliest kill."""
    return events.where("kind = 'champion_kill'").groupBy("game_id").agg(F.min_by("killer", F.struct("t_ms", "event_id")).alias("killer"))


def involvement(events: DataFrame) -> DataFrame:
    """One row per event and part: (game_id, event_id, t_ms, kind, phase, participant_id, part); parts killer, victim, assist.
    Signed evidence is the same rows: the victim's sign is -1."""
    parts = F.array(*[F.struct(F.col(c).alias("participant_id"), F.lit(c).alias("part")) for c in ("killer", "victim", "assist")])
    rows = events.select("game_id", "event_id", "t_ms", "kind", phase(F.col("t_ms")).alias("phase"), "killer", "victim", F.explode(parts).alias("p"))
    return rows.where("p.participant_id is not null and (p.part != 'victim' or kind = 'champion_kill')").select("game_id", "event_id", "t_ms", "kind", "phase", "killer", "victim", "p.*")


def signed_evidence(events: DataFrame) -> DataFrame:
    kill, monster = F.col("kind") == "champion_kill", F.col("kind") == "elite_monster_kill"
    rows = involvement(events.where("kind in ('champion_kill', 'elite_monster_kill', 'building_kill', 'turret_plate')"))
    helped = F.col("part") == "assist"
    metric = F.when(kill & (F.col("part") == "victim"), "death").when(kill, F.when(helped, "champion_kill_assist").otherwise("champion_kill")).when(monster, F.when(helped, "objective_assist").otherwise("objective_secure")).otherwise(F.when(helped, "structure_assist").otherwise("structure_secure"))
    return rows.select("game_id", "event_id", "participant_id", "t_ms", "phase", F.when(metric == "death", -1).otherwise(1).alias("sign"), metric.alias("metric"))


def fight_influence(events: DataFrame, by_phase: bool = False) -> DataFrame:
    """Counts of kills, deaths, assists, trades and the share of the team's kills, per participant (and phase)."""
    keys = ["game_id", "participant_id"] + (["phase"] if by_phase else [])
    rows = involvement(events.where("kind = 'champion_kill'"))
    count = lambda part: F.count_if(F.col("part") == part)
    base = rows.groupBy(*keys).agg(count("killer").alias("kill_events"), count("victim").alias("death_events"), count("assist").alias("assist_events"))
    dead = trades(events).select("game_id", F.col("victim").alias("participant_id"), phase(F.col("t_ms")).alias("phase"), "trade")
    traded = dead.groupBy(*keys).agg(*[F.count_if(F.col("trade") == s).alias(f"{s}_deaths") for s in ("traded", "untraded", "unknown")])
    team_keys = ["game_id", "team"] + (["phase"] if by_phase else [])
    team = rows.where("part = 'killer'").withColumn("team", team_of(F.col("participant_id"))).groupBy(*team_keys).agg(F.count("*").alias("team_kills"))
    out = base.join(traded, keys, "left").withColumn("team", team_of(F.col("participant_id"))).join(team, team_keys, "left")
    rate = (F.col("kill_events") + F.col("assist_events")) / F.col("team_kills")
    return out.select(*keys, "kill_events", "death_events", "assist_events", *[F.coalesce(f"{s}_deaths", F.lit(0)).alias(f"{s}_deaths") for s in ("traded", "untraded", "unknown")], F.round(rate, 6).alias("event_kill_participation"))


def objective_contests(events: DataFrame) -> DataFrame:
    """Monster contacts per participant and those with an own fight within 20 s and 3000 units."""
    own = involvement(events).join(events.select("game_id", "event_id", "x", "y"), ["game_id", "event_id"])
    contacts = own.where("kind = 'elite_monster_kill'")
    fights = own.where("kind = 'champion_kill'")
    near = interval_join(contacts, fights, ["game_id", "participant_id"], CONTEST_MS, CONTEST_MS).where(distance(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y")) <= NEAR)
    held = near.select("l.game_id", "l.participant_id", "l.event_id").distinct().groupBy("game_id", "participant_id").agg(F.count("*").alias("objective_fights"))
    return contacts.groupBy("game_id", "participant_id").agg(F.count("*").alias("direct_contacts"), F.count_if(F.col("part") == "killer").alias("secures")).join(held, ["game_id", "participant_id"], "left").withColumn("objective_fights", F.coalesce("objective_fights", F.lit(0)))


def vision_influence(events: DataFrame) -> DataFrame:
    """Wards placed and killed per participant, and those that an own-team event follows within 20 s and 3000 units."""
    wards = events.where("kind in ('ward_placed', 'ward_kill')")
    followers = events.where("kind in ('champion_kill', 'elite_monster_kill', 'building_kill')")
    near = interval_join(wards, followers, ["game_id"], 0, VISION_MS).where(team_of(F.col("l.killer")) == team_of(F.col("r.killer"))).where(distance(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y")) <= NEAR)
    useful = near.select("l.game_id", "l.event_id").distinct().withColumn("useful", F.lit(1))
    marked = wards.join(useful, ["game_id", "event_id"], "left")
    placed, useful_ = F.col("kind") == "ward_placed", F.col("useful") == 1
    return marked.groupBy("game_id", F.col("killer").alias("participant_id")).agg(
        F.count_if(placed).alias("wards_placed"), F.count_if(~placed).alias("wards_killed"), F.count_if(placed & useful_).alias("actionable_wards"), F.count_if(~placed & useful_).alias("actionable_dewards"), F.round(F.count_if(useful_) / F.count("*"), 6).alias("actionable_rate")
    )


def death_tempo(events: DataFrame) -> DataFrame:
    """Deaths per participant: by phase, rapid pairs (at most 45 s apart) and the smallest gap."""
    w = Window.partitionBy("game_id", "victim").orderBy("t_ms", "event_id")
    deaths = events.where("kind = 'champion_kill'").withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(w))
    return deaths.groupBy("game_id", F.col("victim").alias("participant_id")).agg(F.count("*").alias("deaths"), *[F.count_if(phase(F.col("t_ms")) == p).alias(p) for p, _, _ in PHASES], F.count_if(F.col("gap") <= RAPID_DEATH_MS).alias("rapid_pairs"), F.min("gap").alias("min_gap_ms"))


def enablement_suppression(events: DataFrame) -> DataFrame:
    """Assists to team-mates, kills or assists against enemies, and the victims' own kill and objective counts."""
    rows = involvement(events)
    pressure = rows.where("kind != 'ward_placed' and kind != 'ward_kill' and part != 'victim'").groupBy("game_id", F.col("participant_id").alias("victim")).agg(F.count("*").alias("pressure"))
    acts = rows.where("kind = 'champion_kill' and part != 'victim'").join(pressure, ["game_id", "victim"], "left")
    me, other = team_of(F.col("participant_id")), team_of(F.col("victim"))
    enabled = (F.col("part") == "assist") & (team_of(F.col("killer")) == me)
    return acts.groupBy("game_id", "participant_id").agg(F.count_if(enabled).alias("ally_assists"), F.count_if(me != other).alias("suppressions"), F.sum(F.when(me != other, F.coalesce("pressure", F.lit(0))).otherwise(0)).alias("suppression_weight"))


def lane_opponent(pid: Column) -> Column:
    """The participant of the same role in the other team, for ten participants in role order."""
    return F.when(pid <= 5, pid + 5).otherwise(pid - 5)


def resource_conversion(frames: DataFrame, events: DataFrame, unit: int = 100) -> DataFrame:
    """Frames with a gold lead over the lane opponent, and those that an own event follows within 60 s. Gold in 1/unit."""
    other = frames.select("game_id", "t_ms", lane_opponent(F.col("participant_id")).alias("participant_id"), F.col("gold").alias("other_gold"))
    leads = frames.join(other, ["game_id", "t_ms", "participant_id"]).where(F.col("gold") - F.col("other_gold") > GOLD_LEAD * unit)
    acts = involvement(events.where("kind in ('champion_kill', 'elite_monster_kill', 'building_kill', 'turret_plate')")).where("part != 'victim'")
    hit = interval_join(leads, acts, ["game_id", "participant_id"], 0, CONVERSION_MS).where("r.t_ms > l.t_ms").select("l.game_id", "l.participant_id", "l.t_ms").distinct().withColumn("hit", F.lit(1))
    return leads.join(hit, ["game_id", "participant_id", "t_ms"], "left").groupBy("game_id", "participant_id").agg(F.count("*").alias("lead_windows"), F.count("hit").alias("converted"), F.round(F.count("hit") / F.count("*"), 6).alias("conversion_rate"))


def isolation(frames: DataFrame) -> DataFrame:
    """Frames with a position in which the nearest placed team-mate is farther than 3000."""
    f = frames.where("x is not null").withColumn("team", team_of(F.col("participant_id")))
    mate = f.select("game_id", "t_ms", "team", F.col("participant_id").alias("mate"), F.col("x").alias("mx"), F.col("y").alias("my"))
    nearest = f.join(mate, ["game_id", "t_ms", "team"]).where("mate != participant_id").groupBy("game_id", "participant_id", "t_ms").agg(F.min(distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my"))).alias("d"))
    return nearest.groupBy("game_id", "participant_id").agg(F.count("*").alias("samples"), F.count_if(F.col("d") > NEAR).alias("isolated"))
