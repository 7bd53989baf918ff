"""Registered queries: packets for judging panels, their bundle and the judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import panel
from tallyfield.session import scratch, stored
from tallyfield.sources import views
from tallyfield.sources.view_sql import MATCHES, PARTICIPANTS

SEED, RUBRIC = "panel", "r1"


def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as versions of their game's feature set: the source by supplier, the newest by ship date and line."""
    line = views.table(spark, sf_dir, "lineitem")
    return line.select(F.floor(F.col("l_orderkey") / 10).cast("long").alias("game_id"), F.when(F.col("l_suppkey") % 3 > 0, "lcu_timeline").otherwise("match_v5").alias("source"), F.col("l_shipdate").alias("made_at"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("set_id"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants with a map of features and the opponent of their role; of every 17th game a participant is missing."""
    p = views.participants(spark, sf_dir).join(views.matches(spark, sf_dir).select("game_id", "duration"), "game_id")
    features = {"fight_influence.kills": "kills", "fight_influence.deaths": "deaths", "vision_influence.wards_placed": "wards_placed", "structure_pressure": "damage_to_turrets"}
    maps = F.create_map(*[x for path, c in features.items() for x in (F.lit(path), F.col(c))])
    pid = F.col("participant_id")
    rows = p.select("game_id", pid, "team_id", "champion", "role", F.when(F.col("role") != "jungle", F.when(pid <= 5, pid + 5).otherwise(pid - 5)).alias("opponent_id"), maps.alias("features"), "duration")
    return rows.where("not (game_id % 17 = 3 and participant_id = 4)")


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packets, private map and the rows of both with their game, built and written once."""
    kept = []
    public, private, _ = panel.packets(shown(spark, sf_dir), SEED, RUBRIC, keep=lambda made: kept.append(stored(made, "packets")) or kept[0])
    return public, private, kept[0]


def _packets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _made(spark, sf_dir)[:2]


_H = "substr(sha256('{0}|' || r || '|' || game_id || '|' || {1}), 1, {2})"
_TEXT = "'fight_influence.deaths=' || deaths || ',fight_influence.kills=' || kills || ',structure_pressure=' || damage_to_turrets || ',vision_influence.wards_placed=' || wards_placed"
PACKETS_SQL = f"""{PARTICIPANTS}, {MATCHES}, whole as (select p.*, m.duration, case when role <> 'jungle' then case when participant_id <= 5 then participant_id + 5 else participant_id - 5 end end opp, {_TEXT} ft
  from participants p join matches m using (game_id) where game_id % 17 <> 3 and game_id in (select game_id from participants group by 1 having count(*) = 10)),
s as (select *, {_H.format(SEED, 'participant_id', 12)} subject_id, case when opp is not null then {_H.format(SEED, 'opp', 12)} end opponent, case when (team_id = 100) = ({_H.format(SEED, "'teams'", 1)} < '8') then 'A' else 'B' end team from whole, (values ('a'), ('b')) t(r)),
o as (select *, sha256('{SEED}|order|' || subject_id) ord, sha256(champion || '|' || role || '|' || case when opp is not null then 'subject' else '' end || '|' || ft) print from s),
pk as (select r, game_id, substr(sha256('1|{RUBRIC}|lcu_timeline|' || any_value(duration) || chr(10) || string_agg(subject_id || '|' || team || '|' || champion || '|' || role || '|' || coalesce(opponent, '') || '|' || ft, chr(10) order by ord)), 1, 24) packet_id from o group by 1, 2),
full_packets as (select o.*, packet_id, row_number() over (partition by r, game_id order by ord) place, sha256(game_id || ':' || participant_id || '|' || print) binding from o join pk using (r, game_id))"""


@query("""with f as (select l_orderkey // 10 game_id, case when l_suppkey % 3 > 0 then 'lcu_timeline' else 'match_v5' end source, l_shipdate made_at, l_orderkey * 100 + l_linenumber set_id from lineitem), asked as (select distinct o_orderkey // 10 + case when o_custkey % 50 = 0 then 1000000 else 0 end game_id from orders where o_orderkey % 10 < 2),
n as (select game_id, arg_max(set_id, (made_at, set_id)) set_id from f where source = 'lcu_timeline' and game_id in (select game_id from asked) group by 1)
select game_id, set_id, 'exported' status from n union all select game_id, null, 'missing' from asked where game_id not in (select game_id from f where source = 'lcu_timeline')""")
def s10_newest_feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requested games, of which some are not there."""
    o = views.table(spark, sf_dir, "orders").where("o_orderkey % 10 < 2")
    asked = o.select((F.floor(F.col("o_orderkey") / 10) + F.when(F.col("o_custkey") % 50 == 0, 1_000_000).otherwise(0)).cast("long").alias("game_id"))
    found, missing = panel.newest(feature_sets(spark, sf_dir), "lcu_timeline", ["made_at", "set_id"], asked)
    return found.select("game_id", "set_id", F.lit("exported").alias("status")).unionByName(missing.select("game_id", F.lit(None).cast("long").alias("set_id"), F.lit("missing").alias("status")))


@query(f"""with {PACKETS_SQL} select r as round, packet_id, cast(place as integer) place, subject_id, team, cast(champion as varchar) champion, role, opponent, game_id || ':' || participant_id base_ref, binding from full_packets""")
def m11_s10_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and private map side by side, a row for each subject."""
    public, private = _packets(spark, sf_dir)
    both = public.select("round", "packet_id", "participants").join(private.select("packet_id", "subjects"), "packet_id")
    seen = both.select("round", "packet_id", "subjects", F.posexplode("participants").alias("place", "p"))
    own = F.explode(F.filter("subjects", lambda s: s["subject_id"] == F.col("p.subject_id")))
    rows = seen.select("packet_id", "p.subject_id", "round", (F.col("place") + 1).alias("place"), "p.team", "p.champion", "p.role", "p.opponent", own.alias("s"))
    return rows.select("*", "s.base_ref", "s.binding").drop("s")


@query(f"with {PARTICIPANTS} select game_id, 'participants' reason from participants where not (game_id % 17 = 3 and participant_id = 4) group by 1 having count(*) <> 10")
def m11_rejected_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.packets(shown(spark, sf_dir), SEED, RUBRIC)[2]


def _bundle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packets that were tampered with, by game: 0 evidence of round b, 1 a private map lost, 2 a packet lost, 3 two persons of round b exchanged,
    4 another rubric, 5 a subject renamed, 6 rounds exchanged in the map, 7 a packet twice in the map's round."""
    public, private, made = _made(spark, sf_dir)
    k = F.col("game_id") % 23
    changed = F.transform("participants", lambda p, i: F.when((k == 0) & (F.col("round") == "b") & (i == 0), p.withField("features", F.map_zip_with(p["features"], p["features"], lambda key, a, b: F.when(key == "structure_pressure", a + 1).otherwise(a)))).when((k == 5) & (i == 0), p.withField("subject_id", F.lit("unknown"))).otherwise(p))
    shown_ = made.where(~((k == 2) & (F.col("round") == "a"))).withColumn("participants", changed).select(public.columns)
    swapped = F.transform("subjects", lambda s, i: F.when((k == 3) & (F.col("round") == "b") & (i < 2), s.withField("base_ref", F.col("subjects")[1 - i]["base_ref"])).otherwise(s))
    moved = F.when((k == 6) | ((k == 7) & (F.col("round") == "b")), F.when(F.col("round") == "a", "b").otherwise("a")).otherwise(F.col("round"))
    maps = private.where(~((k == 1) & (F.col("round") == "b"))).withColumns({"subjects": swapped, "round": moved, "rubric_hash": F.when(k == 4, "r0").otherwise(F.col("rubric_hash"))})
    return shown_, maps


@query(f"""with {PACKETS_SQL}, g as (select distinct r, game_id, packet_id, game_id % 23 k from full_packets), d as (select game_id, game_id % 23 k from g group by 1)
select packet_id, game_id, 'binding' reason from g where k in (0, 3) and r = 'b' union all select packet_id, null, 'no_private' from g where k = 1 and r = 'b' union all select packet_id, game_id, 'no_public' from g where k = 2 and r = 'a'
union all select packet_id, game_id, 'rubric' from g where k = 4 union all select packet_id, game_id, 'subjects' from g where k = 5 union all select packet_id, game_id, 'round' from g where k = 6 or (k = 7 and r = 'b')
union all select null, game_id, 'duplicate_game' from d where k = 7 union all select null, game_id, 'rounds' from d where k in (1, 2, 7) union all select null, game_id, 'evidence' from d where k in (0, 3)""")
def m11_bundle_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.bundle_problems(*_bundle(spark, sf_dir), RUBRIC)


@query(f"""with {PACKETS_SQL}, g as (select distinct r, game_id, packet_id, game_id % 23 k from full_packets)
select r as round, packet_id, 'body' reason from g where (k = 0 and r = 'b') or k = 5""")
def s6_packet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets written as JSON lines and read again."""
    path = scratch(spark, "packets-json")
    _bundle(spark, sf_dir)[0].select(F.to_json(F.struct(*[x.strip().split(" ")[0] for x in ("round", "packet_id", "schema_version", "rubric_hash", "evidence_source", "duration", "participants")])).alias("value")).write.text(path)
    read, _ = panel.read_lines(spark, path, panel.PACKET)
    return panel.packet_problems(read, RUBRIC)


def judgments_path(spark: SparkSession, public: DataFrame, games: DataFrame) -> str:
    """One judgment for each packet of round a, as JSON lines; what is wrong with it follows from its game."""
    k = F.col("game_id") % 19
    ids = F.transform("participants", lambda p: p["subject_id"])
    paths = F.when(k == 8, F.array(F.lit("fight_influence.gold"))).when(k == 7, F.array().cast("array<string>")).otherwise(F.array(F.lit("fight_influence"), F.lit("vision_influence.wards_placed"), F.lit("structure_pressure")))
    tags = F.when(k == 5, F.array().cast("array<string>")).when(k == 6, F.array(F.lit("luck"))).otherwise(F.array(F.lit("combat_impact"), F.lit("role_context")))
    text = F.when(k == 9, F.repeat(F.lit("x"), 501)).when(k == 10, F.lit("  ")).otherwise("did more")
    one = lambda p, i: panel.named(subject_id=p, confidence=F.when((k == 4) & (i == 3), 1.5).otherwise(0.75), rationale_tags=tags, evidence_paths=paths, brief_reason=text)
    tiers = F.when(k == 2, F.array(F.slice(ids, 1, 9))).when(k == 11, F.array(ids, F.slice(ids, 1, 1))).when(k == 15, F.array().cast("array<array<string>>")).otherwise(F.array(F.slice(ids, 1, 5), F.slice(ids, 6, 5)))
    given = F.slice(F.transform(ids, one), F.lit(1), F.when(k == 3, 9).when(k == 15, 0).otherwise(10))
    name = F.when(k == 12, "nowhere").otherwise(F.col("packet_id"))
    row = panel.named(packet_id=name, overall_confidence=F.when(k == 1, -0.5).otherwise(0.9), abstain_reason=F.when(k.isin(14, 15), "too little").otherwise(""), ranking_tiers=tiers, assessments=given)
    line = F.when(k == 16, F.lit("{broken")).otherwise(F.to_json(row))
    path = scratch(spark, "judgments-json")
    copies = F.explode(F.sequence(F.lit(1), F.when(k == 13, 2).when(k == 17, 0).otherwise(1)))
    public.where("round = 'a'").join(games, "packet_id").where(k != 17).select(line.alias("value"), copies.alias("c")).drop("c").write.text(path)
    return path


_REASONS = {1: "overall_confidence", 2: "ranking", 3: "assessments", 4: "confidence", 5: "no_tags", 6: "unknown_tags", 7: "path_count", 8: "unknown_path", 9: "brief_reason", 10: "brief_reason", 11: "ranking", 12: "missing", 13: "duplicate", 14: "abstained_with_content", 16: "missing", 17: "missing"}


@query(f"""with {PACKETS_SQL}, g as (select distinct game_id, packet_id, game_id % 19 k from full_packets where r = 'a')
select packet_id, case k {" ".join(f"when {k} then '{r}'" for k, r in _REASONS.items())} end reason from g where k in ({", ".join(map(str, _REASONS))})
union all select 'nowhere', 'unknown_packet' from g where k = 12 union all select 'nowhere', 'duplicate' from g where k = 12 group by k having count(*) > 1 union all select null, 'bad_line' from g where k = 16""")
def p39_s6_judgment_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    public, private = _packets(spark, sf_dir)
    rows, bad = panel.read_lines(spark, judgments_path(spark, public, private.select("packet_id", "game_id")), panel.JUDGMENT)
    return panel.judgment_problems(rows, public.where("round = 'a'")).unionByName(bad.select(F.lit(None).cast("string").alias("packet_id"), F.lit("bad_line").alias("reason")))
