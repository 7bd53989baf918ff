"""Judging panels: blinded packets of matches for several rounds, their private map, and the checks of packets and judgments.

A packet shows ten participants of a match under opaque subjects, in another order and with other names in every round. The
private map says who a subject is, and binds it to the evidence shown: the binding is a hash over the participant's reference and
an order-free canonical form of its evidence, so evidence that was exchanged or changed afterwards is found. Features are
a map from paths to whole numbers; a lane opponent is shown as that packet's subject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators.corpus import violations
from tallyfield.operators.history import latest
from tallyfield.session import stored

SCHEMA_VERSION = 1
ROUNDS = ("a", "b")
MAX_PATHS, MAX_REASON = 6, 500
# What a judge may give as reasons.
TAGS = ("combat_impact", "objective_control", "vision_control", "economy_efficiency", "survivability", "role_context", "teamfight_presence", "laning_phase", "utility_support", "insufficient_data")

_PARTICIPANT = "struct<subject_id: string, team: string, champion: string, role: string, opponent: string, features: map<string, bigint>>"
PACKET = f"round string, packet_id string, schema_version int, rubric_hash string, evidence_source string, duration bigint, participants array<{_PARTICIPANT}>"
JUDGMENT = "packet_id string, overall_confidence double, abstain_reason string, ranking_tiers array<array<string>>, assessments array<struct<subject_id: string, confidence: double, rationale_tags: array<string>, evidence_paths: array<string>, brief_reason: string>>"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def named(**fields: Column) -> Column:
    return F.named_struct(*[x for name, column in fields.items() for x in (F.lit(name), column)])


def features_text(features: Column) -> Column:
    """Sorted path=value pairs: the same for every order of the map; null values are left empty."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(features)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))), ",")


def fingerprint(p: Column, text: Column | None = None) -> Column:
    """Hash of the evidence that a participant shows, the same in every round; ``text`` is its features' text where it is known."""
    return _hash(F.coalesce(p["champion"], F.lit("")), F.coalesce(p["role"], F.lit("")), F.when(p["opponent"].isNotNull(), "subject").otherwise(""), features_text(p["features"]) if text is None else text)


def packet_id(packet: Column, texts: Column | None = None) -> Column:
    """The id of a packet is the hash of what it shows, in the order shown; ``texts`` are its participants' features where known."""
    text = lambda p, i: features_text(p["features"]) if texts is None else F.get(texts, i)
    shown = F.transform(packet["participants"], lambda p, i: F.concat_ws("|", p["subject_id"], p["team"], p["champion"], p["role"], F.coalesce(p["opponent"], F.lit("")), text(p, i)))
    head = F.concat_ws("|", *[packet[c].cast("string") for c in ("schema_version", "rubric_hash", "evidence_source", "duration")])
    return F.substring(F.sha2(F.concat_ws("\n", head, F.array_join(shown, "\n")), 256), 1, 24)


def newest(feature_sets: DataFrame, source: str, order: list[str], requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The newest feature set of a source for each game (of those requested), and the requested games that have none."""
    own = feature_sets.where(F.col("source") == source)
    if requested is None:
        return latest(own, ["game_id"], order), feature_sets.select("game_id").limit(0)
    wanted = requested.select("game_id").distinct()
    return latest(own.join(wanted, "game_id", "left_semi"), ["game_id"], order), wanted.join(own.select("game_id"), "game_id", "left_anti")


def packets(rows: DataFrame, seed: str, rubric_hash: str, rounds: tuple[str, ...] = ROUNDS, source: str = "lcu_timeline", keep: Callable[[DataFrame], DataFrame] = lambda made: made) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(public packets, private map, rejected games with a reason).

    ``rows``: game_id, participant_id, team_id, champion, role, opponent_id, features, duration. A game needs ten different
    participants in two teams and an opponent, where there is one, among them. One row a game and round, built inside the row: one shuffle.
    Packets and map are columns of the same rows; ``keep`` may store these, so that they are built once for both.
    """
    one = F.struct("participant_id", "team_id", "champion", "role", "opponent_id", "features")
    games = rows.groupBy("game_id").agg(F.collect_list(one).alias("ps"), F.max("duration").alias("duration"))
    ids, teams = F.transform("ps", lambda p: p["participant_id"]), F.array_distinct(F.transform("ps", lambda p: p["team_id"]))
    known = F.forall("ps", lambda p: p["opponent_id"].isNull() | F.array_contains(ids, p["opponent_id"]))
    reason = F.when((F.size("ps") != 10) | (F.size(F.array_distinct(ids)) != 10), "participants").when((F.size(teams) != 2) | F.exists("ps", lambda p: p["team_id"].isNull()), "teams").when(~known, "opponent")
    judged = games.withColumns({"reason": reason, "low_team": F.array_min(teams)})
    # what every round shows alike is made once a game: the features' text, and the binding over it
    told = F.transform("ps", lambda p: named(participant_id=p["participant_id"], team_id=p["team_id"], champion=p["champion"].cast("string"), role=p["role"], opponent=p["opponent_id"], features=p["features"], text=features_text(p["features"]), ref=F.concat_ws(":", F.col("game_id"), p["participant_id"])))
    bound = F.transform("told", lambda p: named(p=p, binding=_hash(p["ref"], fingerprint(p, p["text"]))))
    good = judged.where("reason is null").withColumn("told", told).withColumn("ps", bound).drop("told").withColumn("round", F.explode(F.array(*[F.lit(r) for r in rounds])))

    def subject(pid: Column) -> Column:
        return F.substring(_hash(F.lit(seed), F.col("round"), F.col("game_id"), pid), 1, 12)

    turned = F.substring(_hash(F.lit(seed), F.col("round"), F.col("game_id"), F.lit("teams")), 1, 1) < "8"
    named_ = good.withColumns({"turned": turned, "names": F.map_from_entries(F.transform("ps", lambda x: F.struct(x["p"]["participant_id"], subject(x["p"]["participant_id"]))))})
    called = lambda pid: F.element_at("names", pid)
    team = lambda t: F.when((t == F.col("low_team")) == F.col("turned"), "A").otherwise("B")
    shown = lambda p: named(subject_id=called(p["participant_id"]), team=team(p["team_id"]), champion=p["champion"], role=p["role"], opponent=F.when(p["opponent"].isNotNull(), called(p["opponent"])), features=p["features"])
    order = F.sort_array(F.transform("ps", lambda x, i: F.struct(_hash(F.lit(seed), F.lit("order"), called(x["p"]["participant_id"])).alias("o"), i.alias("i"))))
    placed = F.transform(order, lambda o: F.get("ps", o["i"]))
    made = named_.withColumn("placed", placed).withColumns({
        "participants": F.transform("placed", lambda x: shown(x["p"])), "schema_version": F.lit(SCHEMA_VERSION), "rubric_hash": F.lit(rubric_hash), "evidence_source": F.lit(source), "duration": F.col("duration").cast("bigint"),
    })
    body = ["schema_version", "rubric_hash", "evidence_source", "duration", "participants"]
    made = made.withColumn("packet_id", packet_id(F.struct(*body), F.col("placed.p.text")))
    who = F.zip_with("placed", "participants", lambda x, p: named(subject_id=p["subject_id"], base_ref=x["p"]["ref"], binding=x["binding"]))
    made = keep(made.select("round", "packet_id", "game_id", *body, who.alias("subjects")))
    public = made.select("round", "packet_id", *body)
    private = made.select("round", "packet_id", "game_id", "rubric_hash", "subjects")
    return public, private, judged.where("reason is not null").select("game_id", "reason")


def packet_problems(public: DataFrame, rubric_hash: str) -> DataFrame:
    """(round, packet_id, reason) of packets that may not be used: other schema or rubric, changed body, wrong subjects or teams, ids twice in a round."""
    ids = F.transform("participants", lambda p: p["subject_id"])
    side = lambda t: F.size(F.filter("participants", lambda p: p["team"] == t)) == 5
    rules = {
        "schema": F.col("schema_version") == SCHEMA_VERSION,
        "rubric": F.col("rubric_hash") == rubric_hash,
        "body": packet_id(F.struct("schema_version", "rubric_hash", "evidence_source", "duration", "participants")) == F.col("packet_id"),
        "participants": F.size("participants") == 10,
        "subjects": ~F.exists(ids, lambda s: s.isNull()) & (F.size(F.array_distinct(ids)) == F.size(ids)),
        "teams": side("A") & side("B"),
    }
    broken = violations(public.withColumn("__key", F.struct("round", "packet_id")), "__key", rules).select("__key.*", F.col("rule").alias("reason"))
    twice = public.groupBy("round", "packet_id").count().where("count > 1").select("round", "packet_id", F.lit("duplicate").alias("reason"))
    return broken.unionByName(twice)


def bundle_problems(public: DataFrame, private: DataFrame, rubric_hash: str, rounds: tuple[str, ...] = ROUNDS) -> DataFrame:
    """(packet_id, game_id, reason): where public packets and the private map are not one bundle.

    Of one packet: no_private, no_public, round, rubric, subjects (not the same set), references (not the ten of the game),
    binding (evidence or person exchanged). Of a game: duplicate_game (twice in a round), rounds (not in all), evidence (shown
    differently in two rounds).
    """
    # a packet comes to its map with the prints of its participants alone, sorted by subject like the map's entries
    prints = F.sort_array(F.transform("participants", lambda p: named(subject_id=p["subject_id"], print=fingerprint(p))))
    entries = F.sort_array(F.transform("subjects", lambda s: named(subject_id=s["subject_id"], base_ref=s["base_ref"], binding=s["binding"])))
    mine = public.select("packet_id", F.col("round").alias("shown_round"), prints.alias("prints"))
    both = mine.join(private.select("packet_id", "round", "game_id", "rubric_hash", entries.alias("entries")), "packet_id", "full")
    ids = F.transform("prints", lambda p: p["subject_id"])
    want = F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat_ws(":", F.col("game_id"), i)))
    refs = F.sort_array(F.transform("entries", lambda s: s["base_ref"]))
    same = F.coalesce(ids == F.transform("entries", lambda s: s["subject_id"]), F.lit(False)) & (F.size(F.array_distinct(ids)) == F.size(ids))
    seen = both.withColumns({"has_p": F.col("prints").isNotNull(), "has_m": F.col("entries").isNotNull(), "same": same}).withColumn("whole", F.col("has_p") & F.col("has_m"))
    side = F.zip_with("prints", "entries", lambda p, s: named(shown=F.concat_ws("=", s["base_ref"], p["print"]), bound=s["binding"] == _hash(s["base_ref"], p["print"])))
    seen = seen.withColumn("sides", F.when(F.col("whole") & F.col("same"), side))
    reasons = F.array_compact(F.array(
        F.when(~F.col("has_m"), F.lit("no_private")), F.when(~F.col("has_p"), F.lit("no_public")),
        F.when(F.col("whole") & ~F.col("shown_round").eqNullSafe(F.col("round")), F.lit("round")),
        F.when(F.col("whole") & ~F.col("rubric_hash").eqNullSafe(F.lit(rubric_hash)), F.lit("rubric")),
        F.when(F.col("whole") & ~F.col("same"), F.lit("subjects")),
        F.when(F.col("whole") & ~refs.eqNullSafe(want), F.lit("references")),
        F.when(F.col("whole") & F.col("same") & ~F.coalesce(F.forall("sides", lambda s: s["bound"]), F.lit(False)), F.lit("binding")),
    ))
    view = F.when(F.col("sides").isNotNull(), F.sha2(F.array_join(F.sort_array(F.transform("sides", lambda s: s["shown"])), ","), 256))
    found = stored(seen.select("packet_id", "game_id", "round", "whole", reasons.alias("reasons"), view.alias("view")), "bundle")  # read for packets and for games
    of_packet = found.select("packet_id", "game_id", F.explode("reasons").alias("reason"))
    games = found.where("whole").groupBy("game_id").agg(F.count("*").alias("n"), F.collect_set("round").alias("rounds"), F.min("view").alias("low"), F.max("view").alias("high"))
    faults = F.array_compact(F.array(F.when(F.col("n") > F.size("rounds"), F.lit("duplicate_game")), F.when(F.size("rounds") != len(rounds), F.lit("rounds")), F.when(F.col("low") != F.col("high"), F.lit("evidence"))))
    return of_packet.unionByName(games.select(F.lit(None).cast("string").alias("packet_id"), "game_id", F.explode(faults).alias("reason")))


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a JSON-lines file; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._corrupt").isNull() & F.col("value").rlike(r"^\s*\{")
    return read.where(good).select("r.*").drop("_corrupt"), read.where(~good).select("value")


def judgment_problems(judgments: DataFrame, public: DataFrame) -> DataFrame:
    """(packet_id, reason): the first thing wrong with each judgment, judgments twice, and packets without one."""
    known = public.select("packet_id", F.map_from_entries(F.transform("participants", lambda p: F.struct(p["subject_id"], F.map_keys(p["features"])))).alias("paths"))
    j = judgments.join(known, "packet_id", "left")
    subjects = F.array_sort(F.map_keys("paths"))
    tiers, given = F.coalesce("ranking_tiers", F.array().cast("array<array<string>>")), F.filter(F.coalesce("assessments", F.lit([]).cast(judgments.schema["assessments"].dataType)), lambda a: a.isNotNull())
    ranked, assessed = F.array_sort(F.flatten(tiers)), F.array_sort(F.transform(given, lambda a: a["subject_id"]))
    said = F.trim(F.coalesce("abstain_reason", F.lit(""))) != ""
    of = lambda bad: F.exists(given, lambda a: F.coalesce(bad(a), F.lit(True)))
    there = lambda a, path: F.exists(F.element_at("paths", a["subject_id"]), lambda k: (k == path) | k.startswith(F.concat(path, F.lit("."))))
    text = lambda a: F.trim(F.coalesce(a["brief_reason"], F.lit("")))
    reason = (
        F.when(F.col("paths").isNull(), "unknown_packet")
        .when(~F.coalesce(F.col("overall_confidence").between(0, 1), F.lit(False)), "overall_confidence")
        .when(said & ((F.size(tiers) > 0) | (F.size(given) > 0)), "abstained_with_content")
        .when(said, F.lit(None))
        .when(~ranked.eqNullSafe(subjects), "ranking")
        .when(~assessed.eqNullSafe(subjects), "assessments")
        .when(of(lambda a: ~a["confidence"].between(0, 1)), "confidence")
        .when(of(lambda a: F.size(a["rationale_tags"]) < 1), "no_tags")
        .when(of(lambda a: F.size(F.array_except(a["rationale_tags"], F.array(*[F.lit(t) for t in TAGS]))) > 0), "unknown_tags")
        .when(of(lambda a: ~F.size(a["evidence_paths"]).between(1, MAX_PATHS)), "path_count")
        .when(of(lambda a: F.exists(a["evidence_paths"], lambda p: ~F.coalesce(there(a, p), F.lit(False)))), "unknown_path")
        .when(of(lambda a: ~F.length(text(a)).between(1, MAX_REASON)), "brief_reason")
    )
    found = j.select("packet_id", reason.alias("reason")).where("reason is not null")
    twice = judgments.groupBy("packet_id").count().where("count > 1").select("packet_id", F.lit("duplicate").alias("reason"))
    missing = public.select("packet_id").distinct().join(judgments.select("packet_id"), "packet_id", "left_anti").withColumn("reason", F.lit("missing"))
    return found.unionByName(twice).unionByName(missing)
