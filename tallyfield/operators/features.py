"""One feature row per participant and match: counts of objectives and structures, phases, live state, evidence, contracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators import timeline as tl

# Monsters by kind.
GRUBS = ("HORDE",)
EPICS = ("DRAGON", "BARON_NASHOR", "RIFTHERALD", "ATAKHAN")

OBJECTIVES = ("grub_secures", "grub_assists", "epic_monster_secures", "epic_monster_assists", "turret_kills", "turret_assists", "inhibitor_kills", "turret_plates", "objective_fight_involvements", "unknown_objective_contest_context", "direct_objective_contacts")
KEYS = ["game_id", "participant_id"]


def acts(events: DataFrame) -> DataFrame:
    """A row for the killer and one for the helper of each event, with the event's columns and its phase."""
    parts = F.array(*[F.struct(F.col(c).alias("participant_id"), F.lit(c).alias("part")) for c in ("killer", "assist")])
    return events.withColumn("phase", tl.phase(F.col("t_ms"))).withColumn("p", F.explode(parts)).where("p.participant_id is not null").select(*events.columns, "phase", "p.*")


def objective_participation(events: DataFrame, by_phase: bool = False) -> DataFrame:
    """The eleven objective counts per participant (and phase) with an own monster, building or plate event.

    A monster contact is supported by an own fight within 20 s and 3000 units; it is unknown when there are fights in time,
    none of them near, and a position is missing. With ``by_phase`` a fight counts only in the phase of the contact.
    """
    keys = KEYS + (["phase"] if by_phase else [])
    own = acts(events)
    monsters = own.where("kind = 'elite_monster_kill'")
    fights = tl.involvement(events.where("kind = 'champion_kill'")).join(events.select("game_id", "event_id", "x", "y"), ["game_id", "event_id"])
    near = tl.interval_join(monsters, fights, KEYS, tl.CONTEST_MS, tl.CONTEST_MS)
    if by_phase:
        near = near.where("l.phase = r.phase")
    gap = tl.distance(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y"))
    contest = near.groupBy(*[F.col(f"l.{k}").alias(k) for k in KEYS], F.col("l.event_id").alias("event_id")).agg(F.max((F.coalesce(gap, F.lit(1e9)) <= tl.NEAR).cast("int")).alias("close"), F.count_if(gap.isNull()).alias("unplaced"))
    counted = own.join(contest, [*KEYS, "event_id"], "left")
    monster, building = F.col("kind") == "elite_monster_kill", F.col("kind") == "building_kill"
    first, helped = F.col("part") == "killer", F.col("part") == "assist"
    grub, epic = monster & F.col("monster_type").isin(*GRUBS), monster & F.col("monster_type").isin(*EPICS)
    tower, inhibitor = building & (F.col("building_type") == "TOWER_BUILDING"), building & (F.col("building_type") == "INHIBITOR_BUILDING")
    rules = (grub & first, grub & helped, epic & first, epic & helped, tower & first, tower & helped, inhibitor & first, (F.col("kind") == "turret_plate") & first, monster & (F.col("close") == 1), monster & (F.col("close") == 0) & (F.col("unplaced") > 0), monster)
    some = counted.where("kind in ('elite_monster_kill', 'building_kill', 'turret_plate')")
    return some.groupBy(*keys).agg(*[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in zip(OBJECTIVES, rules)])


def structure_pressure(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Secured and helped structures, plates, the sorted lanes of them, and isolated frames, per participant."""
    objective = objective_participation(events)
    lanes = acts(events).where("kind in ('building_kill', 'turret_plate') and lane is not null").groupBy(*KEYS).agg(F.sort_array(F.collect_set("lane")).alias("lanes_pressured"))
    alone = tl.isolation(frames).select(*KEYS, F.col("isolated").alias("isolated_frame_samples"))
    out = objective.select(*KEYS, (F.col("turret_kills") + F.col("inhibitor_kills")).alias("structure_secures"), F.col("turret_assists").alias("structure_assists"), "turret_plates").join(lanes, KEYS, "full").join(alone, KEYS, "full")
    zero = ("structure_secures", "structure_assists", "turret_plates", "isolated_frame_samples")
    return out.select(*KEYS, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], F.coalesce("lanes_pressured", F.array().cast("array<string>")).alias("lanes_pressured"))


def live_state(samples: DataFrame) -> DataFrame:
    """Last values, share of samples in which the player is dead, and the longest timer seen, per participant."""
    last = lambda c: F.max_by(c, "t_ms").alias(f"final_{c}")
    return samples.groupBy(*KEYS).agg(F.count("*").alias("observed_samples"), *[last(c) for c in ("level", "kills", "deaths", "assists", "cs", "item_count")], F.round(F.avg(F.coalesce("is_dead", F.lit(False)).cast("double")), 4).alias("dead_sample_rate"), F.max("respawn_timer").alias("max_respawn_timer"))


def phase_breakdown(events: DataFrame) -> DataFrame:
    """Fights and objectives of each participant in each of the three phases; the match has one first blood."""
    fights = tl.fight_influence(events, by_phase=True)
    blood = events.where("kind = 'champion_kill'").groupBy("game_id").agg(F.min_by(F.struct(F.col("killer").alias("k"), tl.phase(F.col("t_ms")).alias("phase")), F.struct("t_ms", "event_id")).alias("b"))
    first = blood.select("game_id", F.col("b.k").alias("participant_id"), "b.phase", F.lit(True).alias("first_blood"))
    spine = roster(events).select(*KEYS, F.explode(F.array(*[F.lit(p) for p, _, _ in tl.PHASES])).alias("phase"))
    keys = [*KEYS, "phase"]
    out = spine.join(fights, keys, "left").join(objective_participation(events, by_phase=True), keys, "left").join(first, keys, "left")
    counts = ("kill_events", "death_events", "assist_events", "traded_deaths", "untraded_deaths", "unknown_deaths", *OBJECTIVES)
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("first_blood", F.lit(False)).alias("first_blood"))


def roster(events: DataFrame) -> DataFrame:
    """Ten participants for each match that has events."""
    return events.select("game_id").distinct().select("game_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("participant_id"))


def evidence_counts(events: DataFrame, frames: DataFrame, samples: DataFrame) -> DataFrame:
    """Events, participants with frames and participants with live samples, per match."""
    rows = events.groupBy("game_id").agg(F.count("*").alias("events"))
    framed = frames.groupBy("game_id").agg(F.count_distinct("participant_id").alias("framed_participants"))
    live = samples.groupBy("game_id").agg(F.count_distinct("participant_id").alias("live_participants"))
    out = rows.join(framed, "game_id", "full").join(live, "game_id", "full")
    return out.select("game_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "framed_participants", "live_participants")])


# Columns of a row's families: counts, which are 0 without own events, and values, which stay null.
FAMILIES = {
    "fight_influence": (("kill_events", "death_events", "assist_events", "traded_deaths", "untraded_deaths", "unknown_deaths"), ("first_blood", "event_kill_participation")),
    "objective_participation": (OBJECTIVES, ()),
    "structure_pressure": (("structure_secures", "structure_assists", "turret_plates", "isolated_frame_samples"), ("lanes_pressured",)),
    "enablement_suppression": (("ally_assists", "suppressions", "suppression_weight"), ()),
    "vision_influence": (("wards_placed", "wards_killed", "actionable_wards", "actionable_dewards"), ("actionable_rate",)),
    "death_tempo": (("deaths", "rapid_pairs"), ("min_gap_ms",)),
    "resource_conversion": (("lead_windows", "converted"), ("conversion_rate",)),
    "live_state": ((), ("observed_samples", "final_level", "final_kills", "dead_sample_rate", "max_respawn_timer")),
}


def extract_features(events: DataFrame, frames: DataFrame, samples: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row per participant of each match with events, and a struct per family.

    Counts are 0 where the match has events and the participant none; rates, gaps and the whole live state stay null
    without evidence. ``raw`` adds its own columns as a struct. All families are joined on (match, participant).
    """
    blood = tl.first_blood(events).select("game_id", F.col("killer").alias("participant_id"), F.lit(True).alias("first_blood"))
    found = {
        "fight_influence": tl.fight_influence(events).join(blood, KEYS, "left"),
        "objective_participation": objective_participation(events),
        "structure_pressure": structure_pressure(events, frames),
        "enablement_suppression": tl.enablement_suppression(events),
        "vision_influence": tl.vision_influence(events),
        "death_tempo": tl.death_tempo(events),
        "resource_conversion": tl.resource_conversion(frames, events),
        "live_state": live_state(samples),
    }
    out = roster(events)
    if raw is not None:
        out = out.join(raw.select(*KEYS, F.struct(*[c for c in raw.columns if c not in KEYS]).alias("raw")), KEYS, "left")
    for name, (counts, values) in FAMILIES.items():
        out = out.join(found[name].select(*KEYS, *[F.col(c).alias(f"{name}__{c}") for c in (*counts, *values)]), KEYS, "left")

    def value(name: str, column: str) -> Column:
        x = F.col(f"{name}__{column}")
        if column == "first_blood":
            return F.coalesce(x, F.lit(False))
        return F.coalesce(x, F.array().cast("array<string>")) if column == "lanes_pressured" else x

    structs = [F.struct(*[F.coalesce(f"{n}__{c}", F.lit(0)).alias(c) for c in counts], *[value(n, c).alias(c) for c in values]).alias(n) for n, (counts, values) in FAMILIES.items()]
    return out.select(*KEYS, *(["raw"] if raw is not None else []), *structs)


@dataclass(frozen=True)
class Feature:
    """A value of a feature row: where it lies, the direction it may act in, its transform, and what evidence it needs."""

    name: str
    path: str
    direction: int
    transform: str = "log1p"
    needs: str = "events"


# The features that models may use, in their order.
CONTRACT = (
    Feature("fight_kill_events", "fight_influence.kill_events", 1),
    Feature("fight_death_events", "fight_influence.death_events", -1),
    Feature("fight_assist_events", "fight_influence.assist_events", 1),
    Feature("fight_first_blood", "fight_influence.first_blood", 1, "identity"),
    Feature("fight_untraded_deaths", "fight_influence.untraded_deaths", -1),
    Feature("fight_kill_participation", "fight_influence.event_kill_participation", 1, "clamp01"),
    Feature("objective_epic_secures", "objective_participation.epic_monster_secures", 1),
    Feature("objective_grub_secures", "objective_participation.grub_secures", 1),
    Feature("objective_fight_involvements", "objective_participation.objective_fight_involvements", 1),
    Feature("objective_turret_kills", "objective_participation.turret_kills", 1),
    Feature("objective_turret_assists", "objective_participation.turret_assists", 1),
    Feature("objective_turret_plates", "objective_participation.turret_plates", 1),
    Feature("objective_inhibitor_kills", "objective_participation.inhibitor_kills", 1),
    Feature("structure_secures", "structure_pressure.structure_secures", 1),
    Feature("enablement_ally_assists", "enablement_suppression.ally_assists", 1),
    Feature("enablement_suppression_weight", "enablement_suppression.suppression_weight", 1),
    Feature("vision_actionable_rate", "vision_influence.actionable_rate", 1, "clamp01", "wards"),
    Feature("death_tempo_count", "death_tempo.deaths", -1),
    Feature("death_tempo_rapid_pairs", "death_tempo.rapid_pairs", -1),
    Feature("resource_conversion_rate", "resource_conversion.conversion_rate", 1, "clamp01", "frames"),
    Feature("raw_kills", "raw.kills", 1, "log1p", "always"),
    Feature("raw_deaths", "raw.deaths", -1, "log1p", "always"),
    Feature("raw_assists", "raw.assists", 1, "log1p", "always"),
    Feature("live_dead_sample_rate", "live_state.dead_sample_rate", -1, "clamp01", "live"),
)

# What evidence a tier has, the tiers by priority.
TIERS = {
    "match_v5": ("always", "events", "wards", "frames"),
    "lcu_timeline": ("always", "events", "frames"),
    "live_client": ("always", "events", "live"),
    "aggregate": ("always",),
}


def contract(tier: str) -> tuple[Feature, ...]:
    """The features that a tier's evidence supports."""
    return tuple(f for f in CONTRACT if f.needs in TIERS[tier])


def model_values(rows: DataFrame, features: tuple[Feature, ...] = CONTRACT) -> DataFrame:
    """The features of each row as columns: booleans 0 or 1, transformed, null where they are missing."""

    def column(f: Feature) -> Column:
        x = F.col(f.path).cast("double")
        y = F.log1p(F.greatest(x, F.lit(0.0))) if f.transform == "log1p" else F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) if f.transform == "clamp01" else x
        return F.when(x.isNotNull(), y).alias(f.name)  # greatest and least skip nulls

    return rows.select(*KEYS, *[column(f) for f in features])


def best_tier(evidence: DataFrame) -> DataFrame:
    """(game_id, tier, completeness): the most complete tier, then the one of higher priority; aggregate only without others.

    ``evidence`` has (game_id, tier, completeness); a tier without completeness counts as whole, one with 0 as absent.
    """
    order = F.create_map(*[x for i, t in enumerate(TIERS) for x in (F.lit(t), F.lit(-i))])
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("completeness", F.lit(1.0))))
    rows = evidence.where(F.col("tier").isin(*TIERS)).select("game_id", "tier", share.alias("completeness")).where("completeness > 0")
    key = F.struct(F.when(F.col("tier") == "aggregate", -1.0).otherwise(F.col("completeness")), order[F.col("tier")])
    best = rows.groupBy("game_id").agg(F.max_by(F.struct("tier", "completeness"), key).alias("b"))
    return best.select("game_id", "b.*")


def best_session(sessions: DataFrame) -> DataFrame:
    """Per game the finished session with the largest completeness, then the latest update, then the largest id."""
    fit = sessions.where("(status = 'completed' or status like 'partial!_%' escape '!') and completeness > 0")
    key = F.struct(F.least(F.lit(1.0), F.col("completeness")), F.coalesce("updated_at", F.lit("")), "session_id")
    return fit.groupBy("game_id").agg(F.max_by("session_id", key).alias("session_id"), F.max(F.least(F.lit(1.0), F.col("completeness"))).alias("completeness"))


def capabilities(games: DataFrame, timelines: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per game the completeness of each tier and the best one. ``timelines`` has (game_id, tier, completeness)."""
    live = best_session(sessions).select("game_id", F.lit("live_client").alias("tier"), "completeness")
    known = games.select("game_id", F.lit("aggregate").alias("tier"), F.lit(1.0).alias("completeness"))
    every = known.unionByName(timelines.select("game_id", "tier", F.col("completeness").cast("double").alias("completeness"))).unionByName(live.withColumn("completeness", F.col("completeness").cast("double")))
    shares = every.groupBy("game_id").pivot("tier", list(TIERS)).agg(F.max("completeness"))
    return shares.select("game_id", *[F.coalesce(t, F.lit(0.0)).alias(t) for t in TIERS]).join(best_tier(every).select("game_id", F.col("tier").alias("best_tier")), "game_id")
