"""Registered queries: fitting and applying models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import comparison, models, shapes
from tallyfield.session import scratch, stored
from tallyfield.sources import views
from tallyfield.sources.view_sql import MATCHES, PARTICIPANTS

_FEATURES = {"kills": 0.4, "assists": 0.3, "deaths": -0.5}
#: The reference's constants; so many steps that the tolerances end the fit.
_REFERENCE = {"l2": 0.05, "rate": 0.05, "iterations": 20_000}


@query(f"""with {PARTICIPANTS}, a as (select *, kills * 0.4 + assists * 0.3 - deaths * 0.5 - case role when 'jungle' then 0.25 when 'support' then -0.25 else 0.0 end adj from participants),
s as (select *, round(least(100.0, greatest(0.0, 50 + 50 * tanh(adj / 2.0))), 9) score from a), h as (select *, greatest(0.0, score - 3) low, least(100.0, score + 3) high from s),
n as (select *, row_number() over w r, abs(score - lag(score) over w) / nullif((high - low + lag(high - low) over w) / 2, 0) g1, abs(score - lead(score) over w) / nullif((high - low + lead(high - low) over w) / 2, 0) g2 from h window w as (partition by game_id order by score desc, participant_id))
select game_id, participant_id, round(score, 6) score, cast(r as integer) model_rank, round(coalesce(least(least(1.0, g1), least(1.0, g2)), 1.0), 6) rank_confidence from n""")
def m5_w4_score_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.participants(spark, sf_dir)
    s = models.score_model(p, models.linear_score(_FEATURES), list(_FEATURES), {"jungle": 0.25, "support": -0.25}, 2.0)
    return s.select("game_id", "participant_id", F.round("score", 6).alias("score"), "model_rank", F.round("rank_confidence", 6).alias("rank_confidence"))


def _training(spark: SparkSession, sf_dir: str, participants: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Items, labelled pairs and directions. A fit reads both many times, so they are written once."""
    names = {"kills": 1, "assists": 1, "deaths": -1}
    p = views.participants(spark, sf_dir) if participants is None else participants
    p = stored(p.select("game_id", "participant_id", "role", "damage_to_champions", *names).withColumn("item_ref", F.concat_ws(":", "game_id", "participant_id")), "items")
    side = lambda at, value: p.where(at).select("game_id", ((F.col("participant_id") - 1) % 5 + 1).alias("place"), F.col("damage_to_champions").alias(value))
    ends = side("participant_id <= 5", "a").join(side("participant_id > 5", "b"), ["game_id", "place"])
    ref = lambda place: F.concat_ws(":", "game_id", place)
    labelled = ends.select("game_id", ref(F.col("place")).alias("left_ref"), ref(F.col("place") + 5).alias("right_ref"), F.when(F.col("a") > F.col("b"), "left").when(F.col("a") < F.col("b"), "right").otherwise("tie").alias("choice"))
    return p, stored(labelled, "labelled"), names


@query()
def m14_m18_fit_pairwise_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring participants of a match as pairs, the composite's damage decides. Checked by recovery in the tests."""
    p, labelled, names = _training(spark, sf_dir)
    fit = models.fit_pairwise_linear(models.pair_differences(labelled, models.normalize(p, list(names)), list(names)), names, **_REFERENCE)
    scored = p.withColumn("raw", models.linear_score(fit.coefficients))
    offsets, scale = models.calibrate(scored)
    return models.score_model(p, models.linear_score(fit.coefficients), list(names), offsets, scale).select("game_id", "participant_id", "score", "model_rank")


@query()
def m15_fit_pairwise_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs, names = _training(spark, sf_dir)
    fit = shapes.fit_pairwise_gam(pairs, p, names, **_REFERENCE)
    return p.select("game_id", "participant_id", models.spline_score(fit).alias("raw"))


@query()
def m16_fit_boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 100 rounds; a fifth of the games ends the fit. Checked against plain rounds in the tests."""
    p, pairs, names = _training(spark, sf_dir)
    return p.select("game_id", "participant_id", shapes.shape_score(shapes.fit_boosted_stumps(pairs, p, names, group="game_id")).alias("raw"))


@query()
def m17_fit_monotone_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against plain recursion in the tests."""
    p, pairs, names = _training(spark, sf_dir)
    return p.select("game_id", "participant_id", shapes.fit_monotone_tree(pairs, p, names).column().alias("raw"))


_BUCKET = "cast('0x' || substr(sha256(cast(game_id as varchar)), 1, 2) as integer)"
_SPLIT = f"case when {_BUCKET} < 26 then 'test' when {_BUCKET} < 52 then 'validation' else 'train' end"


def split_of(game: str) -> Column:
    """A game's split by two digits of its hash."""
    bucket = F.conv(F.substring(F.sha2(F.col(game).cast("string"), 256), 1, 2), 16, 10).cast("int")
    return F.when(bucket < 26, "test").when(bucket < 52, "validation").otherwise("train")


def _split_training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    p, pairs, names = _training(spark, sf_dir)
    return p, pairs.withColumn("split", split_of("game_id")).drop("game_id"), names


@query()
def m19_compare_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pairs, names = _split_training(spark, sf_dir)
    return comparison.compare_families(p, pairs, names)[0]


@query()
def m20_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a fixed linear score; its parts have SQL of their own (A20 to A28, W11)."""
    p, pairs, _ = _training(spark, sf_dir)
    scored = comparison.scored_pairs(pairs, p, models.linear_score(_FEATURES))
    roles = p.select("item_ref", "role")
    both = scored.join(roles.select(F.col("item_ref").alias("left_ref"), F.col("role").alias("left_role")), "left_ref").join(roles.select(F.col("item_ref").alias("right_ref"), F.col("role").alias("right_role")), "right_ref")
    return comparison.report(both.withColumn("confidence", F.abs(F.col("p") - 0.5) * 2), {"role": "role"}, confidence="confidence")


_VERSIONS = f"""{PARTICIPANTS}, {MATCHES}, sets as (select p.*, s.source, v.version, date '2024-01-01' + cast((p.game_id * v.version) % 5 as integer) created_at from participants p join matches m using (game_id) cross join (select unnest(['match_v5', 'aggregate']) source) s cross join (select unnest([1, 2]) as version) v where s.source = 'aggregate' or m.duration >= 900),
newest as (select game_id, source, max((created_at, version)) v from sets group by 1, 2),
records as (select s.game_id, s.participant_id, s.source, s.version, s.kills, s.deaths, s.assists, s.role, {_SPLIT.replace("game_id", "s.game_id")} split, s.game_id || ':' || s.participant_id base_ref, s.game_id || ':' || s.participant_id || ':' || s.source item_ref from sets s join newest n on n.game_id = s.game_id and n.source = s.source and n.v = (s.created_at, s.version) join matches m on m.game_id = s.game_id and m.queue < 5)"""


_RATED = "source = 'aggregate' or duration >= 900"


def _sources() -> Column:
    return F.explode(F.array(F.lit("match_v5"), F.lit("aggregate"))).alias("source")


def feature_sets(participants: DataFrame, matches: DataFrame) -> DataFrame:
    """Two versions of two sources of the participants' counts; short games have only the weaker source."""
    p = participants.repartition("game_id").join(matches.select("game_id", "duration", "queue"), "game_id")  # before rows are multiplied
    rows = p.select("*", _sources()).where(_RATED).withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.withColumn("created_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("game_id") * F.col("version") % 5).cast("int")))


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records and labels, from participants that are written once."""
    p, m = stored(views.participants(spark, sf_dir), "participants"), views.matches(spark, sf_dir)
    manifest = m.where("queue < 5").select("game_id", "duration", _sources()).where(_RATED).select("game_id", "source")
    records = comparison.training_records(manifest, feature_sets(p, m), m.select("game_id", split_of("game_id").alias("split")))
    return records, _training(spark, sf_dir, p)[1].drop("game_id")


@query(f"with {_VERSIONS} select game_id, participant_id, source, version, split, base_ref, item_ref from records")
def m13_s4_training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a training set, read again with its counts checked."""
    path = scratch(spark, "training-set")
    records, labels = _records(spark, sf_dir)
    comparison.write_training_set(records, lambda written: comparison.training_pairs(labels, written), path)
    return comparison.read_training_set(spark, path)[0].select("game_id", "participant_id", "source", "version", "split", "base_ref", "item_ref")


@query(f"""with {_VERSIONS}, ends as (select game_id, participant_id, damage_to_champions d from participants),
pairs as (select a.game_id || ':' || a.participant_id left_ref, b.game_id || ':' || b.participant_id right_ref, case when a.d > b.d then 'left' when a.d < b.d then 'right' else 'tie' end choice from ends a join ends b on a.game_id = b.game_id and b.participant_id = a.participant_id + 5),
t as (select base_ref, count(*) filter (source = 'match_v5') m, count(*) filter (source = 'aggregate') a from records group by 1)
select p.left_ref, p.right_ref, p.choice, coalesce(x.m, 0) + coalesce(y.m, 0) = 2 match_v5, coalesce(x.a, 0) + coalesce(y.a, 0) = 2 "aggregate" from pairs p left join t x on x.base_ref = p.left_ref left join t y on y.base_ref = p.right_ref""")
def j20_tiers_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, labels = _records(spark, sf_dir)
    return comparison.side_by_side(labels, records, ["match_v5", "aggregate"])


@query()
def m33_train_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third tier has no records, so its model is neutral."""
    records, labels = _records(spark, sf_dir)
    records = stored(records.select("base_ref", "source", "role", "split", "kills", "assists", "deaths"), "records")
    pairs = stored(comparison.training_pairs(labels, records), "pairs")
    wanted = {"kills": 1, "assists": 1, "deaths": -1}
    return comparison.train_tiers(records, pairs.where("split = 'train'").drop("split"), {"match_v5": wanted, "aggregate": {"kills": 1, "deaths": -1}, "live_client": {"kills": 1}})


@query(f"""with {PARTICIPANTS}, {MATCHES}, l as (select m.game_id, p.team_id, p.win from matches m join participants p on p.game_id = m.game_id and p.participant_id = m.local_id)
select distinct p.game_id, p.team_id, case when p.team_id = l.team_id then cast(l.win as integer) else 1 - cast(l.win as integer) end::double outcome from participants p join l using (game_id)""")
def p37_s7_team_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, path = views.participants(spark, sf_dir), scratch(spark, "outcomes")
    m = views.matches(spark, sf_dir)
    won = p.select("game_id", F.col("participant_id").alias("local_id"), F.col("win").alias("local_win"))
    comparison.write_outcomes(comparison.team_outcomes(m.join(won, ["game_id", "local_id"]), p), path)
    return spark.read.parquet(path)
