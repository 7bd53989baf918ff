"""Libraries of expectations: nested trees of what scores must show, checked and evaluated in three-valued logic.

A case carries its expectation as JSON. A leaf asks for a gap, a bound, a place or too short a game, or for a person's review;
``compound`` holds if all its parts hold, ``any_of`` if one does, ``negation`` if its part does not, to any depth. What cannot be
known is null and spreads as in SQL. A tree becomes rows, a level of it at a time; leaves are answered by joins, and each
case's nodes are folded in post-order inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.corpus import violations
from tallyfield.session import stored
from tallyfield.sources.documents import secrets

# What cases are about, how they were checked, and the fields that each kind of leaf needs.
CATEGORIES = ("tank", "support", "split_pusher", "weak_side_play", "short_game", "low_kda_influence", "vision_without_conversion", "raw_economy_without_influence", "objective_contact_without_contest", "disputed_score")
STATUSES = ("verified_local", "synthetic")
LEAVES = {
    "pairwise_minimum_gap": ("winner", "loser", "min_gap"),
    "must_not_rank_first_solely_on_metric": ("subject", "metric"),
    "must_not_exceed": ("subject", "max_score"),
    "insufficient_evidence": ("duration_threshold_seconds",),
    "disputed_manual_review": (),
}
INNER = ("compound", "any_of", "negation")
_NODE = "type string, winner string, loser string, subject string, metric string, min_gap string, max_score string, duration_threshold_seconds string, sub_expectations array<string>"


def nodes(cases: DataFrame, expectation: str = "expectation") -> DataFrame:
    """(case_id, game_id, path, json, arity, *fields): a row for each node of each tree; a path is places, five digits each.

    A text that is no JSON object is one node without a type. One job a level; the number of levels is that of the deepest tree.
    """
    level = cases.select("case_id", "game_id", F.lit("00000").alias("path"), F.col(expectation).alias("json"))
    out = None
    while True:
        read = stored(level.select("case_id", "game_id", "path", "json", F.from_json("json", _NODE).alias("n")).select("case_id", "game_id", "path", "json", "n.*").withColumn("arity", F.when(F.col("type").isin(*INNER), F.coalesce(F.size("sub_expectations"), F.lit(0))).otherwise(0)), "expectation-level")
        out = read if out is None else out.unionByName(read)
        below = read.where("arity > 0").select("case_id", "game_id", "path", F.posexplode("sub_expectations").alias("k", "json"))
        level = below.select("case_id", "game_id", F.concat_ws(".", "path", F.lpad(F.col("k").cast("string"), 5, "0")).alias("path"), "json")
        if read.where("arity > 0").isEmpty():
            return out.drop("sub_expectations")


def node_problem() -> Column:
    """What is wrong with a node, null if nothing."""
    kind = F.col("type")
    reason = F.when(kind.isNull() | ~kind.isin(*LEAVES, *INNER), "unknown_type").when(kind.isin(*INNER) & (F.col("arity") == 0), "no_parts").when((kind == "negation") & (F.col("arity") != 1), "negation_of_many")
    parsed = F.try_parse_json("json")
    for leaf, fields in LEAVES.items():
        for f in fields:
            reason = reason.when((kind == leaf) & F.try_variant_get(parsed, f"$.{f}", "variant").isNull(), f"missing_{f}")
    number = F.schema_of_variant(F.try_variant_get(parsed, "$.max_score", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return reason.when((kind == "must_not_exceed") & ~F.coalesce(number, F.lit(False)), "max_score_not_numeric")


def library_problems(cases: DataFrame) -> DataFrame:
    """(case_id, reason) of everything that makes a case unfit; ``cases`` has case_id, category, verification_status, game_id, provenance, expectation and the case's text as ``json``."""
    verified = F.col("verification_status") == "verified_local"
    rules = {
        "category": F.col("category").isin(*CATEGORIES),
        "verification_status": F.col("verification_status").isin(*STATUSES),
        "verified_without_game": ~F.coalesce(verified, F.lit(False)) | (F.coalesce("game_id", F.lit(0)) != 0),
        "verified_without_provenance": ~F.coalesce(verified, F.lit(False)) | (F.coalesce(F.size("provenance"), F.lit(0)) > 0),
    }
    plain = violations(cases, "case_id", rules).select("case_id", F.col("rule").alias("reason"))
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate").alias("reason"))
    trees = nodes(cases).withColumn("reason", node_problem()).where("reason is not null").select("case_id", "reason").distinct()
    hidden = secrets(cases, "json", "case_id").select("case_id", F.lit("disallowed").alias("reason")).distinct()
    return plain.unionByName(twice).unionByName(trees).unionByName(hidden)


def leaf_values(leaves: DataFrame, scores: DataFrame, durations: DataFrame) -> DataFrame:
    """Adds ``passed`` to leaves: null where a score or duration is missing, or where a person must look."""
    w = Window.partitionBy("game_id").orderBy(F.desc("score"), "subject")
    tops = scores.where("score is not null").withColumn("k", F.row_number().over(w)).where("k = 1").select("game_id", F.col("subject").alias("top"))
    d = leaves
    for c in ("winner", "loser", "subject"):
        d = d.join(scores.select("game_id", F.col("subject").alias(c), F.col("score").alias(f"{c}_score")), ["game_id", c], "left")
    d = d.join(tops, "game_id", "left").join(durations.select("game_id", "duration"), "game_id", "left")
    kind, number = F.col("type"), lambda c: F.col(c).try_cast("double")
    passed = (
        F.when(kind == "insufficient_evidence", F.col("duration") < number("duration_threshold_seconds"))
        .when(kind == "pairwise_minimum_gap", F.col("winner_score") - F.col("loser_score") >= number("min_gap"))
        .when(kind == "must_not_rank_first_solely_on_metric", F.when(F.col("subject_score").isNotNull(), F.col("top") != F.col("subject")))
        .when(kind == "must_not_exceed", F.col("subject_score") <= number("max_score"))
    )
    return d.select(*leaves.columns, passed.alias("passed"))


def evaluate(cases: DataFrame, scores: DataFrame, durations: DataFrame) -> DataFrame:
    """(case_id, passed, parts, resolved) of each case; ``scores``: game_id, subject, score. The best score goes first, ties to the smaller subject.

    parts counts the leaves, resolved those with an answer. An inner node without parts, or a negation of several, is unknown.
    """
    tree = stored(nodes(cases), "expectation-nodes")
    inner = F.col("type").isin(*INNER) & (F.col("arity") > 0)
    leaves = leaf_values(tree.where(~F.coalesce(inner, F.lit(False))), scores, durations).select("case_id", "path", "type", F.lit(0).alias("arity"), "passed")
    every = leaves.unionByName(tree.where(inner).select("case_id", "path", "type", "arity", F.lit(None).cast("boolean").alias("passed")))
    value = F.when(F.col("passed").isNull(), 1).when(F.col("passed"), 2).otherwise(0)
    node = F.struct(F.concat("path", F.lit("~")).alias("key"), "type", "arity", value.alias("v"))  # ~ sorts after . and digits: parts before their whole
    per = every.groupBy("case_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"), F.count_if(F.col("arity") == 0).alias("parts"), F.count_if(F.col("passed").isNotNull()).alias("resolved"))

    def step(stack: Column, x: Column) -> Column:
        below, args = F.slice(stack, F.lit(1), F.size(stack) - x["arity"]), F.slice(stack, F.size(stack) - x["arity"] + 1, x["arity"])
        whole = F.when(x["arity"] == 0, x["v"]).when(x["type"] == "compound", F.array_min(args)).when(x["type"] == "any_of", F.array_max(args)).when(x["arity"] == 1, 2 - F.get(args, F.lit(0))).otherwise(1)
        return F.concat(below, F.array(whole))

    result = F.get(F.aggregate("nodes", F.array().cast("array<int>"), step), F.lit(0))
    return per.select("case_id", F.when(result == 2, True).when(result == 0, False).alias("passed"), "parts", "resolved")
