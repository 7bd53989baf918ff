"""Rank, calibration and agreement metrics over scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators import order_statistics


def with_group(df: DataFrame, keys: tuple[str, ...]):
    return df.groupBy(*keys) if keys else df.groupBy()


def pairwise_accuracy(pairs: DataFrame, *keys: str) -> DataFrame:
    """correct, scored, ties and unscoreable pairs; accuracy over the scored ones with a decisive choice."""
    ok = F.col("left_score").isNotNull() & F.col("right_score").isNotNull()
    decisive = ok & F.col("choice").isin("left", "right")
    right = decisive & F.when(F.col("choice") == "left", F.col("left_score") > F.col("right_score")).otherwise(F.col("right_score") > F.col("left_score"))
    out = with_group(pairs, keys).agg(F.count_if(decisive).alias("scored"), F.count_if(right).alias("correct"), F.count_if(F.col("choice") == "tie").alias("ties"), F.count_if(~ok).alias("unscoreable"))
    return out.withColumn("accuracy", F.try_divide("correct", "scored"))


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or NaN."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def pearson(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Over the rows with both values; null under two of them or without variance, and no row for a key without any."""
    out = with_group(complete(df, x, y), keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return out.select(*keys, "n", F.when(F.col("n") > 1, F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Pearson of the average ranks of the rows with both values."""
    return order_statistics.rank_correlation(complete(df, x, y), x, y, *keys)


def kendall_tau_b(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Tie-corrected concordance of the rows with both values; null when one side is all ties."""
    return order_statistics.kendall(df, x, y, *keys)


def brier(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mean squared error of p(left); a tie's target is 0.5."""
    target = F.when(F.col("choice") == "left", 1.0).when(F.col("choice") == "right", 0.0).when(F.col("choice") == "tie", 0.5)
    return with_group(pairs.withColumn("__t", target).where("__t is not null and p is not null"), keys).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("__t"), F.lit(2))).alias("brier"))


def calibration_bins(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of p: rows, mean p, share of left among decisive pairs, and the bin's part of the expected error."""
    d = pairs.where("choice in ('left', 'right') and p is not null").withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int"))
    per = d.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg((F.col("choice") == "left").cast("double")).alias("rate"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("bin", "n", "mean_p", "rate", (F.col("n") / F.col("total") * F.abs(F.col("mean_p") - F.col("rate"))).alias("error"))


def expected_calibration_error(pairs: DataFrame, bins: int = 10) -> DataFrame:
    return calibration_bins(pairs, bins).agg(F.sum("n").alias("n"), F.sum("error").alias("ece"))


def net_wins(pairs: DataFrame, *keys: str) -> DataFrame:
    """+1 and -1 per decisive pair for its ends, summed per item."""
    left = F.col("choice") == "left"
    ends = F.array(F.struct(F.col("left_ref").alias("item"), F.when(left, 1).otherwise(-1).alias("w")), F.struct(F.col("right_ref").alias("item"), F.when(left, -1).otherwise(1).alias("w")))
    return pairs.where("choice in ('left', 'right')").select(*keys, F.explode(ends).alias("e")).groupBy(*keys, F.col("e.item").alias("item")).agg(F.sum("e.w").alias("net_wins"))


def rank_agreement(rows: DataFrame, group: str, truth: str, score: str, item: str, at_least: int = 3) -> DataFrame:
    """Per group of enough rows: exact and within-one rank agreement, same top and bottom, and NDCG of the score's order.

    Relevance is the number of items below in the true order; equal values go by item.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    w = lambda c: Window.partitionBy(group).orderBy(F.desc(c), item)
    r = rows.withColumns({"n": n, "a": F.row_number().over(w(truth)), "b": F.row_number().over(w(score))}).where(F.col("n") >= at_least)
    gain = lambda at: (F.pow(F.lit(2.0), F.least(F.col("n") - F.col("a"), F.lit(20))) - 1) / F.log2(F.col(at) + 1.0)
    return r.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("a") == F.col("b")).alias("exact"),
        F.count_if(F.abs(F.col("a") - F.col("b")) <= 1).alias("within_one"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("top"),
        F.count_if((F.col("a") == F.col("n")) & (F.col("b") == F.col("n"))).alias("bottom"),
        F.try_divide(F.sum(gain("b")), F.sum(gain("a"))).alias("ndcg"),
    )


def risk_coverage(rows: DataFrame, confidence: str, wrong: str, order: str, points: int = 10) -> DataFrame:
    """Error among the most confident rows at evenly spaced, distinct counts.

    Rows are numbered over ranges of (confidence, order), so no task holds all rows, nor all of one confidence. Rows without
    a confidence are left out.
    """
    known = rows.where(F.col(confidence).isNotNull())
    ranked = order_statistics.numbered(known, F.desc(confidence), F.asc(order), running={"w": F.col(wrong).cast("int")})
    targets = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.greatest(F.lit(1), F.floor(F.col("total") * i / points)).cast("long")))
    return ranked.where(F.array_contains(targets, F.col("number").cast("long"))).select(F.col("number").alias("covered"), F.col("w").alias("wrong"), (F.col("w") / F.col("number")).alias("risk"))


def reviewer_agreement(labels: DataFrame, item: str = "pair_id", rater: str = "reviewer_id", choice: str = "choice") -> DataFrame:
    """Items with several raters, and how many of them are unanimous."""
    per = labels.groupBy(item).agg(F.count_distinct(rater).alias("raters"), F.count_distinct(choice).alias("choices")).where("raters > 1")
    return per.agg(F.count("*").alias("items"), F.count_if(F.col("choices") == 1).alias("unanimous"))


def cohens_kappa(two: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Agreement of two raters beyond chance, from the contingency table."""
    table = two.groupBy(a, b).agg(F.count("*").alias("n"))
    n = table.agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    ra = table.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("na"))
    rb = table.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, "c").agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    both = n.crossJoin(chance)
    po, pe = F.col("same") / F.col("total"), F.col("cross") / (F.col("total") * F.col("total"))
    return both.select(F.col("total").alias("n"), po.alias("observed"), pe.alias("expected"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def robust_center(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median and 1.4826 x MAD (1.0 without spread) per key."""
    out = order_statistics.centers(df, value, *keys)
    return out.select(*keys, "center", F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(1.0).alias("scale"))


def shrunk_offsets(df: DataFrame, key: str, value: str, strength: float = 5.0) -> DataFrame:
    """Mean per key, shrunk by n / (n + strength)."""
    per = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return per.select(key, "n", (F.col("mean") * F.col("n") / (F.col("n") + strength)).alias("offset"))


def cluster_bootstrap(rows: DataFrame, cluster: str, hit: Column, draws: int = 200, seed: int = 0) -> DataFrame:
    """Mean, spread and range of a rate over resampled clusters.

    Each cluster enters as two counts; its weight in a draw is Poisson(1) from a hash of (cluster, draw, seed), so the
    resample needs no copy of the rows and is the same in every run.
    """
    per = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.count_if(hit).alias("k"))
    u = (F.xxhash64(F.col(cluster), "draw", F.lit(seed)).bitwiseAND(0xFFFFFFFFFFFF)) / float(1 << 48)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    each = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight).groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col("k")), F.sum(F.col("w") * F.col("n"))).alias("rate"))
    return each.agg(F.count("rate").alias("draws"), F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std"), F.min("rate").alias("low"), F.max("rate").alias("high"))
