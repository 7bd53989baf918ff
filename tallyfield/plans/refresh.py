"""Registered queries: incremental refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators.features import TIERS
from tallyfield.operators.refresh import EvidenceRefresh
from tallyfield.session import scratch
from tallyfield.sources import views
from tallyfield.sources.view_sql import PARTICIPANTS

_COEFFICIENTS = {"match_v5": {"kills": 0.5, "assists": 0.3, "deaths": -0.6}, "live_client": {"kills": 0.4, "assists": 0.2, "deaths": -0.3}, "aggregate": {"kills": 0.3, "deaths": -0.3}}
ARTIFACTS = {tier: (1, c) for tier, c in _COEFFICIENTS.items()}  # the tier lcu_timeline has no model
CUTS = (900, 1700, 1 << 40)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evidence of their game: the tier by supplier, numbered by the day."""
    line = views.table(spark, sf_dir, "lineitem")
    source = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    day = F.date_diff("l_shipdate", F.lit("1992-01-01")).cast("long")
    return line.select(F.floor(F.col("l_orderkey") / 10).cast("long").alias("game_id"), source.alias("source"), day.alias("seq"), (F.col("l_linenumber") % 5 / 4).cast("double").alias("completeness"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("item"))


def _sum(tier: str) -> str:
    return " + ".join(f"{c} * {w}" for c, w in _COEFFICIENTS[tier].items())


@query(f"""with {PARTICIPANTS}, arr as (select l_orderkey // 10 game_id, ['match_v5', 'lcu_timeline', 'live_client', 'aggregate'][l_suppkey % 4 + 1] source, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) seq, (l_linenumber % 5) / 4 c, l_orderkey * 100 + l_linenumber item from lineitem),
cuts as (select * from (values (1, -100000, {CUTS[0]}), (2, {CUTS[0]}, {CUTS[1]}), (3, {CUTS[1]}, {CUTS[2]})) t(b, lo, hi)),
changed as (select distinct b, hi, game_id from arr join cuts on seq > lo and seq <= hi),
seen as (select b, game_id, source tier, arg_max(c, (seq, item)) c from changed join arr using (game_id) where seq <= hi group by all),
able as (select b, game_id, tier, c from seen where c > 0 and tier in ('match_v5', 'live_client') union all select b, game_id, 'aggregate', 1.0 from changed),
best as (select b, game_id, arg_max(tier, (case when tier = 'aggregate' then -1 else c end, tier = 'match_v5')) tier, arg_max(c, (case when tier = 'aggregate' then -1 else c end, tier = 'match_v5')) c from able group by all),
act as (select game_id, arg_max(tier, (case tier when 'match_v5' then 3 when 'live_client' then 1 else 0 end, b)) tier, arg_max(c, (case tier when 'match_v5' then 3 when 'live_client' then 1 else 0 end, b)) c from best group by game_id),
s as (select game_id, participant_id, tier, c, case tier {" ".join(f"when '{t}' then {_sum(t)}" for t in _COEFFICIENTS)} end raw from act join participants using (game_id)),
k as (select *, round(least(100.0, greatest(0.0, 50 + 50 * tanh(raw / 2.0) * (0.5 + 0.5 * c))), 9) score from s)
select game_id, participant_id, tier, round(c, 6) completeness, round(score, 6) score, cast(row_number() over (partition by game_id order by score desc, participant_id) as integer) model_rank from k""")
def m32_evidence_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence lands in three parts, and after each the changed games are refreshed."""
    worker = EvidenceRefresh(spark, scratch(spark, "evidence-store"), ARTIFACTS, buckets=16)
    rows = arrivals(spark, sf_dir)
    players = views.participants(spark, sf_dir).select("game_id", "participant_id", "role", "kills", "deaths", "assists")
    for low, high in zip((-(1 << 40), *CUTS), CUTS):
        worker.land(rows.where((F.col("seq") > low) & (F.col("seq") <= high)))
        worker.refresh(lambda changed: players.join(changed, "game_id", "left_semi"))
    return worker.active_scores().select("game_id", "participant_id", "tier", F.round("completeness", 6).alias("completeness"), F.round("score", 6).alias("score"), "model_rank")
