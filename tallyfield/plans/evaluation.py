"""Registered queries: evaluation of scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.catalog import query
from tallyfield.operators import evaluation as ev
from tallyfield.sources import views
from tallyfield.sources.view_sql import PAIRS, PARTICIPANTS

_R = 9


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, _R) for n in names})


@query(f"with {PAIRS} select source, count(*) filter (choice in ('left', 'right')) scored, count(*) filter ((choice = 'left' and left_score > right_score) or (choice = 'right' and right_score > left_score)) correct, count(*) filter (choice = 'tie') ties, cast(0 as bigint) unscoreable, round(correct / nullif(scored, 0), 9) accuracy from pairs group by source")
def a20_a21_pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.pairwise_accuracy(views.label_pairs(spark, sf_dir), "source"), "accuracy")


@query(f"with {PAIRS} select lang, count(*) n, round((sum(cast(left_score as double) * right_score) / count(*) - avg(left_score) * avg(right_score)) / sqrt(var_pop(left_score) * var_pop(right_score)), 6) pearson from pairs group by lang having count(*) > 1")
def a22_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pearson(views.label_pairs(spark, sf_dir), "left_score", "right_score", "lang").where("n > 1").withColumn("pearson", F.round("pearson", 6))


@query(f"with {PAIRS}, r as (select lang, rank() over (partition by lang order by left_score) + (count(*) over (partition by lang, left_score) - 1) / 2 a, rank() over (partition by lang order by right_score) + (count(*) over (partition by lang, right_score) - 1) / 2 b from pairs) select lang, count(*) n, round(corr(a, b), 6) spearman from r group by lang")
def a23_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.spearman(views.label_pairs(spark, sf_dir), "left_score", "right_score", "lang").withColumn("spearman", F.round("spearman", 6))


@query(f"""with {PARTICIPANTS}, p as (select a.game_id, sign(a.gold_earned - b.gold_earned) dx, sign(a.kills - b.kills) dy from participants a join participants b on a.game_id = b.game_id and a.participant_id < b.participant_id)
select game_id, round(sum(dx * dy) / nullif(sqrt(cast(count(*) filter (dx <> 0) * count(*) filter (dy <> 0) as double)), 0), 9) tau_b from p group by game_id""")
def a24_kendall_tau_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.kendall_tau_b(views.participants(spark, sf_dir), "gold_earned", "kills", "game_id"), "tau_b")


@query(f"with {PAIRS}, e as (select left_ref item, case choice when 'left' then 1 else -1 end w from pairs where choice <> 'tie' union all select right_ref, case choice when 'left' then -1 else 1 end from pairs where choice <> 'tie') select item, cast(sum(w) as bigint) net_wins from e group by item")
def a25_net_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.net_wins(views.label_pairs(spark, sf_dir))


@query(f"""with {PARTICIPANTS}, r as (select game_id, count(*) over (partition by game_id) n, row_number() over (partition by game_id order by gold_earned desc, participant_id) a, row_number() over (partition by game_id order by damage_to_champions desc, participant_id) b from participants)
select game_id, count(*) n, count(*) filter (a = b) exact, count(*) filter (abs(a - b) <= 1) within_one, count(*) filter (a = 1 and b = 1) top, count(*) filter (a = n and b = n) bottom,
round(sum((pow(2.0, n - a) - 1) / log2(b + 1.0)) / sum((pow(2.0, n - a) - 1) / log2(a + 1.0)), 9) ndcg from r group by game_id""")
def a26_rank_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.rank_agreement(views.participants(spark, sf_dir), "game_id", "gold_earned", "damage_to_champions", "participant_id"), "ndcg")


@query(f"with {PAIRS} select source, count(*) n, round(avg(pow(p - case choice when 'left' then 1.0 when 'right' then 0.0 else 0.5 end, 2)), 9) brier from pairs group by source")
def a27_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.brier(views.label_pairs(spark, sf_dir), "source"), "brier")


@query(f"with {PAIRS}, b as (select least(9, floor(p * 10)) b, count(*) n, avg(p) m, avg(case choice when 'left' then 1.0 else 0.0 end) r from pairs where choice <> 'tie' group by 1) select cast(sum(n) as bigint) n, round(sum(n * abs(m - r)) / sum(n), 9) ece from b")
def a28_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.expected_calibration_error(views.label_pairs(spark, sf_dir)), "ece")


@query(f"""with {PAIRS}, d as (select *, greatest(p, 1 - p) c, (p > 0.5) <> (choice = 'left') bad from pairs where choice <> 'tie'),
r as (select row_number() over w k, sum(bad::int) over (order by c desc, left_ref rows unbounded preceding) wr, count(*) over () n from d window w as (order by c desc, left_ref))
select cast(k as bigint) covered, cast(wr as bigint) wrong, round(wr / k, 9) risk from r where k in (select greatest(1, floor(n * i / 10)) from range(1, 11) t(i))""")
def w11_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.label_pairs(spark, sf_dir).where("choice != 'tie'").withColumns({"c": F.greatest(F.col("p"), 1 - F.col("p")), "bad": (F.col("p") > 0.5) != (F.col("choice") == "left")})
    return _rounded(ev.risk_coverage(d, "c", "bad", "left_ref"), "risk")


_TWO = "two as (select case when quality = 1 then 'good' else 'bad' end a, case when n_chars > 1500 then 'good' else 'bad' end b, doc_id from documents join labels using (doc_id))"


def _raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("a"), F.when(F.col("n_chars") > 1500, "good").otherwise("bad").alias("b"))


@query(f"with {_TWO} select count(*) items, count(*) filter (a = b) unanimous from two")
def a17_reviewer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _raters(spark, sf_dir)
    labels = two.select(F.col("doc_id").alias("pair_id"), F.explode(F.array(F.struct(F.lit("r1").alias("reviewer_id"), F.col("a").alias("choice")), F.struct(F.lit("r2").alias("reviewer_id"), F.col("b").alias("choice")))).alias("l")).select("pair_id", "l.*")
    return ev.reviewer_agreement(labels)


@query(f"with {_TWO}, s as (select count(*) n, count(*) filter (a = b) / count(*) po, (count(*) filter (a = 'good') * count(*) filter (b = 'good') + count(*) filter (a = 'bad') * count(*) filter (b = 'bad')) / pow(count(*), 2) pe from two) select n, round(po, 9) observed, round(pe, 9) expected, round((po - pe) / nullif(1 - pe, 0), 9) kappa from s")
def a18_cohens_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ev.cohens_kappa(_raters(spark, sf_dir)), "observed", "expected", "kappa")


@query(f"with {PARTICIPANTS}, m as (select role, gold_earned, median(gold_earned) over (partition by role) c from participants), d as (select role, c center, median(abs(gold_earned - c)) mad from m group by role, c) select role, center, case when mad > 0 then round(mad * 1.4826, 6) else 1.0 end scale from d")
def a30_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.robust_center(views.participants(spark, sf_dir), "gold_earned", "role").withColumn("scale", F.round("scale", 6))


@query(f"with {PARTICIPANTS} select role, count(*) n, round(avg(cs) * count(*) / (count(*) + 5.0), 6) as \"offset\" from participants group by role")
def a31_role_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.shrunk_offsets(views.participants(spark, sf_dir), "role", "cs").withColumn("offset", F.round("offset", 6))


@query()
def m21_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded resampling; checked in the tests against the plain rate."""
    return ev.cluster_bootstrap(views.participants(spark, sf_dir), "game_id", F.col("kills") > F.col("deaths"))
