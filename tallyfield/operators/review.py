"""Comparing models, checking expectations, picking evidence, and coaching rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.evaluation import pearson
from tallyfield.operators.components import connected_components
from tallyfield.operators.order_statistics import numbered

# Order in which good events are shown.
PICK_ORDER = ("objective_secure", "structure_secure", "champion_kill", "objective_assist", "structure_assist", "champion_kill_assist")


def compare_models(first: DataFrame, second: DataFrame, keys: tuple[str, str] = ("game_id", "participant_id")) -> DataFrame:
    """Both models' score and rank side by side, with their differences."""
    a = first.select(*keys, F.col("score").alias("score_1"), F.col("rank").alias("rank_1"))
    b = second.select(*keys, F.col("score").alias("score_2"), F.col("rank").alias("rank_2"), "abstain")
    return a.join(b, list(keys)).withColumns({"score_delta": F.col("score_2") - F.col("score_1"), "rank_delta": F.col("rank_2") - F.col("rank_1")})


def shadow_summary(compared: DataFrame) -> DataFrame:
    """One row: coverage, mean absolute score difference, correlation, exact and within-one rank agreement.
    Abstained rows only count for coverage."""
    told = compared.where("not abstain")
    agree = told.agg(F.count("*").alias("told"), F.avg(F.abs("score_delta")).alias("mae"), F.avg((F.col("rank_delta") == 0).cast("double")).alias("exact"), F.avg((F.abs("rank_delta") <= 1).cast("double")).alias("within_one"))
    total = compared.agg(F.count("*").alias("compared"))
    corr = pearson(told, "score_1", "score_2").select("pearson")
    return total.crossJoin(agree).crossJoin(corr).withColumn("coverage", F.try_divide("told", "compared"))


STATUSES = ("error", "no_supported_evidence", "missing_feature_set", "evidence_ready_no_artifact", "missing_v1_run", "invalid_v1_run", "scored")


def shadow_status(requested: DataFrame, games: DataFrame, routed: DataFrame, feature_sets: DataFrame, first: DataFrame, second: DataFrame, artifacts: bool = True, size: int = 10) -> DataFrame:
    """(game_id, source, status) for every requested game once, whatever is missing.

    ``routed``: game_id, source (the tier that would be scored); ``feature_sets``: game_id, source; ``first`` and ``second``: scored
    participants of both models. In this order: the game is unknown (error), no tier fits, its features are missing, there is no
    model at all, the first model has no run or not ``size`` participants, the second does not match all of them (error), scored.
    """
    wanted = requested.select("game_id").where("game_id is not null").distinct()
    have = lambda df, name: df.select("game_id").distinct().withColumn(name, F.lit(True))
    d = wanted.join(have(games, "__known"), "game_id", "left").join(routed.select("game_id", "source"), "game_id", "left")
    d = d.join(feature_sets.select("game_id", "source").distinct().withColumn("__features", F.lit(True)), ["game_id", "source"], "left")
    one = first.groupBy("game_id").agg(F.count_distinct("participant_id").alias("__one"))
    both = first.select("game_id", "participant_id").distinct().join(second.select("game_id", "participant_id").distinct(), ["game_id", "participant_id"]).groupBy("game_id").agg(F.count("*").alias("__both"))
    d = d.join(one, "game_id", "left").join(both, "game_id", "left")
    status = (
        F.when(F.col("__known").isNull(), "error").when(F.col("source").isNull(), "no_supported_evidence").when(F.col("__features").isNull(), "missing_feature_set")
        .when(F.lit(not artifacts), "evidence_ready_no_artifact").when(F.col("__one").isNull(), "missing_v1_run").when(F.col("__one") != size, "invalid_v1_run")
        .when(F.coalesce("__both", F.lit(0)) != size, "error").otherwise("scored")
    )
    return d.select("game_id", F.when(F.col("__known").isNotNull(), F.col("source")).alias("source"), status.alias("status"))


def check_expectations(cases: DataFrame, scores: DataFrame, durations: DataFrame) -> DataFrame:
    """(case_id, passed): every part of a case checked against the scores of its game.

    ``cases`` has a row for each part: (case_id, part, game_id, type, winner, loser, subject, min_gap, max_score,
    threshold). A part is null when what it needs is missing or it asks for manual review. A case is false if a part is,
    else null if a part is, else true.
    """
    best = F.max_by("subject", F.struct("score", "subject")).alias("top")
    tops = scores.groupBy("game_id").agg(best)
    named = lambda c: scores.select("game_id", F.col("subject").alias(c), F.col("score").alias(f"{c}_score"))
    d = cases
    for c in ("winner", "loser", "subject"):
        d = d.join(named(c), ["game_id", c], "left")
    d = d.join(tops, "game_id", "left").join(durations.select("game_id", "duration"), "game_id", "left")
    kind = F.col("type")
    passed = (
        F.when(kind == "insufficient_evidence", F.col("duration") < F.col("threshold"))
        .when(kind == "pairwise_minimum_gap", F.col("winner_score") - F.col("loser_score") >= F.col("min_gap"))
        .when(kind == "must_not_rank_first_solely_on_metric", F.when(F.col("subject_score").isNotNull(), F.col("top") != F.col("subject")))
        .when(kind == "must_not_exceed", F.col("subject_score") <= F.col("max_score"))
    )
    value = F.when(passed.isNull(), 1).when(passed, 2).otherwise(0)
    worst = d.groupBy("case_id").agg(F.min(value).alias("v"))
    return worst.select("case_id", F.when(F.col("v") == 0, False).when(F.col("v") == 2, True).alias("passed"))


def clock(t_ms: Column) -> Column:
    s = F.floor(F.greatest(F.lit(0), F.coalesce(t_ms, F.lit(0))) / 1000)
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def evidence_picks(signed: DataFrame, n: int = 2) -> DataFrame:
    """Per participant the n first negative and the n most important positive events, by time; each as 'mm:ss metric'."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in PICK_ORDER]), F.col("metric")), F.lit(0))
    order = F.when(F.col("sign") > 0, F.when(rank == 0, 10).otherwise(rank)).otherwise(0)
    w = Window.partitionBy("game_id", "participant_id", "sign").orderBy(order, "t_ms", "event_id")
    kept = signed.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    line = F.struct("t_ms", "event_id", F.concat_ws(" ", clock(F.col("t_ms")), F.col("metric")).alias("text"))
    return kept.groupBy("game_id", "participant_id").agg(F.array_sort(F.collect_list(line)).alias("l")).select("game_id", "participant_id", F.transform("l", lambda x: x["text"]).alias("picks"))


def coaching_patterns(rows: DataFrame, rules: list[tuple[str, str, Column]], player: str = "puuid", role: str = "role", at_least: int = 3, share: float = 0.5) -> DataFrame:
    """(player, role, pattern, hits, games): the first rule, in their order, that holds in enough of a player's games.

    A rule is (role or '*', name, condition). It needs ``at_least`` hits and ``share`` of the games in the role.
    """
    flags = [F.when((F.lit(r) == "*") | (F.col(role) == r), F.struct(F.lit(i).alias("order"), F.lit(name).alias("pattern"), F.coalesce(ok, F.lit(False)).alias("hit"))) for i, (r, name, ok) in enumerate(rules)]
    long = rows.select(player, role, F.explode(F.array_compact(F.array(*flags))).alias("f"))
    per = long.groupBy(player, role, "f.order", "f.pattern").agg(F.count("*").alias("games"), F.count_if("f.hit").alias("hits")).where((F.col("hits") >= at_least) & (F.col("hits") >= share * F.col("games")))
    return per.groupBy(player, role).agg(F.min_by(F.struct("pattern", "hits", "games"), "order").alias("b")).select(player, role, "b.*")


def temporal_split(edges: DataFrame, game: str, player: str, time: str, shares: tuple = (("train", 0.8), ("validation", 0.1), ("test", 0.1))) -> DataFrame:
    """(game, component, split): whole components ordered by their newest game, the oldest share first.

    Components are numbered over ranges of (newest game, component), not in one sorted task.
    """
    nodes = edges.select((F.col(game) * 2).alias("src"), (F.col(player) * 2 + 1).alias("dst"))
    comp = connected_components(nodes).where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias(game), "component")
    games = comp.join(edges.select(game, time).distinct(), game)
    newest = numbered(games.groupBy("component").agg(F.max(time).alias("newest")).where("newest is not null"), F.asc("newest"), F.asc("component"))
    at, total, out = (F.col("number") - 1) / F.col("total"), 0.0, None
    for name, share in shares:
        total += share
        out = F.when(at < total - 1e-9, name) if out is None else out.when(at < total - 1e-9, name)
    return comp.join(newest.select("component", out.otherwise(shares[-1][0]).alias("split")), "component").select(game, "component", "split")


def lane_comparison(snapshots: DataFrame) -> DataFrame:
    """Per snapshot and player: differences to the enemy of the same position; ``gold`` is what the held items cost."""
    keys = ["session_id", "t", "position"]
    enemy = snapshots.select(*keys, F.col("team").alias("enemy_team"), F.col("player").alias("enemy"), F.col("cs").alias("enemy_cs"), F.col("level").alias("enemy_level"), F.col("gold").alias("enemy_gold"))
    return snapshots.join(enemy, keys).where("team != enemy_team").select(*keys, "player", "enemy", (F.col("cs") - F.col("enemy_cs")).alias("cs_delta"), (F.col("level") - F.col("enemy_level")).alias("level_delta"), (F.col("gold") - F.col("enemy_gold")).alias("gold_delta"), (F.col("cs") / F.greatest(F.col("t") / 60.0, F.lit(1.0))).alias("cs_per_minute"))


def invested_gold(players: DataFrame, prices: DataFrame, items: str = "items", *keys: str) -> DataFrame:
    """Sum of the prices of held items per key; unknown items cost nothing."""
    held = players.select(*keys, F.explode_outer(items).alias("item_id")).join(prices, "item_id", "left")
    return held.groupBy(*keys).agg(F.sum(F.coalesce("price", F.lit(0))).alias("gold"))
