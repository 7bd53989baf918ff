"""Score history: summaries, lists, reports, lookbacks, run selection and retry state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evidence tiers from weak to strong.
PRIORITY = {"aggregate": 0, "live_client": 1, "lcu_timeline": 2, "match_v5": 3}
# Seconds until the next attempt after the n-th failure.
RETRY_SECONDS = (300, 900, 3600, 21600, 86400, 604800)


def tier_priority(tier: Column) -> Column:
    """-2 for an unknown tier."""
    out = F.lit(-2)
    for name, p in PRIORITY.items():
        out = F.when(tier == name, p).otherwise(out)
    return out


def win_rate(games: DataFrame, *keys: str) -> DataFrame:
    """games, wins and win_rate per key; over no rows the rate is null."""
    return games.groupBy(*keys).agg(F.count("*").alias("games"), F.count_if("win").alias("wins"), (F.try_divide(F.count_if("win") * 100.0, F.count("*"))).alias("win_rate"))


def player_summary(rows: DataFrame, player: str = "puuid", recent: int = 20) -> DataFrame:
    """Per player over all games and the most recent ones: counts, win rates, mean score, best and mean rank."""
    newest = F.row_number().over(Window.partitionBy(player).orderBy(F.desc("creation"), F.desc("game_id"), F.desc("participant_id")))
    marked = rows.withColumn("__new", newest <= recent)
    return marked.groupBy(player).agg(
        F.count("*").alias("games"),
        F.count_if("win").alias("wins"),
        F.count_if(F.col("__new")).alias("recent_games"),
        F.count_if(F.col("__new") & F.col("win")).alias("recent_wins"),
        F.avg("total_score").alias("avg_score"),
        F.min("match_rank").alias("best_rank"),
        F.avg("match_rank").alias("avg_rank"),
    )


def grouped_rates(rows: DataFrame, player: str = "puuid") -> DataFrame:
    """Win rates per player overall, by champion and by role in one pass; what a row groups by is not null."""
    return rows.groupingSets([[player], [player, "champion"], [player, "role"]], player, "champion", "role").agg(F.count("*").alias("games"), F.count_if("win").alias("wins"))


def history_page(rows: DataFrame, offset: int = 0, limit: int = 25) -> DataFrame:
    """Newest games of the local participants with the best and worst rank among their team-mates."""
    mates = rows.groupBy("game_id", "team_id").agg(F.array_sort(F.collect_list("match_rank")).alias("ranks"))
    own = rows.where("participant_id = local_id").join(mates, ["game_id", "team_id"])
    others = F.array_remove("ranks", F.col("match_rank"))
    page = own.select("game_id", "creation", "champion", "role", "win", "match_rank", F.array_min(others).alias("best_mate"), F.array_max(others).alias("worst_mate"))
    return page.orderBy(F.desc("creation"), F.desc("game_id")).offset(max(0, offset)).limit(min(100, max(1, limit)))


def role_order(role: Column) -> Column:
    out = F.lit(5)
    for i, r in enumerate(("top", "jungle", "mid", "bot", "support")):
        out = F.when(role == r, i).otherwise(out)
    return out


def run_report(rows: DataFrame) -> DataFrame:
    """Participants of every run in board order."""
    place = F.row_number().over(Window.partitionBy("game_id").orderBy("team_id", role_order(F.col("role")), "participant_id"))
    return rows.withColumn("place", place)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key by the order columns, without a sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__r")).select("__r.*")


def active_runs(runs: DataFrame, key: str = "game_id") -> DataFrame:
    """The run that counts for each game: strongest tier, then model version, then newest, then id. Never downgrades."""
    order = F.struct(tier_priority(F.col("tier")), "model_version", "created_at", "run_id")
    return runs.groupBy(key).agg(F.max_by(F.struct(*runs.columns), order).alias("__r")).select("__r.*")


def run_list(runs: DataFrame, active: DataFrame) -> DataFrame:
    """All runs with ``is_active`` and their place in the list of their game, newest first."""
    marked = runs.join(active.select("game_id", F.col("run_id").alias("__active")), "game_id", "left").withColumn("is_active", F.col("run_id").eqNullSafe(F.col("__active"))).drop("__active")
    return marked.withColumn("place", F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("created_at"), F.desc("run_id"))))


def legacy_runs(scores: DataFrame, active: DataFrame) -> DataFrame:
    """(game_id, run_id, model_version, participants): one immutable run for each game that has legacy scores and no active run.

    The id is the hash of the game, the version and the sorted scores, so the same scores give the same run; games in ``active`` add nothing.
    """
    rows = scores.join(active.select("game_id").distinct(), "game_id", "left_anti")
    one = F.concat_ws(":", "participant_id", "total_score", "match_rank")
    per = rows.groupBy("game_id").agg(F.min_by("model_version", "participant_id").alias("model_version"), F.count("*").alias("participants"), F.array_sort(F.collect_list(F.struct("participant_id", one.alias("t")))).alias("rows"))
    run = F.sha2(F.concat_ws("|", "game_id", "model_version", F.array_join(F.transform("rows", lambda x: x["t"]), ",")), 256)
    return per.select("game_id", run.alias("run_id"), "model_version", "participants")


def lookback(rows: DataFrame, k: int = 5, keys: tuple[str, ...] = ("puuid", "role"), time: str = "creation", eligible: Column | None = None, value: str = "total_score") -> DataFrame:
    """Adds ``previous``: the last ``k`` values of eligible rows strictly before the row's time, newest first.

    Rows of the same instant do not see each other, and rows with a null key or time see nothing. Each instant with eligible rows carries the
    newest k values up to it, from a frame of k instants; every instant takes those of the last one before it. So a
    row costs the same however long its key's history is.
    """
    stamped = rows.withColumn("__t", F.unix_micros(F.col(time).cast("timestamp")))
    kept = F.struct(F.col("__t").alias("t"), F.col("game_id"), F.col(value).alias("v"))
    kept = kept if eligible is None else F.when(eligible, kept)
    newest = lambda x: F.slice(F.sort_array(x, asc=False), 1, k)
    instants = stamped.groupBy(*keys, "__t").agg(newest(F.collect_list(kept)).alias("__own")).withColumn("__has", F.size("__own") > 0)
    recent = newest(F.flatten(F.collect_list("__own").over(Window.partitionBy(*keys, "__has").orderBy("__t").rowsBetween(1 - k, 0))))
    before = F.last(F.when(F.col("__has"), F.col("__recent")), True).over(Window.partitionBy(*keys).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
    seen = instants.withColumn("__recent", recent).withColumn("__before", before).select(*keys, "__t", "__before")
    out = stamped.join(seen, [*keys, "__t"], "left").select(*[F.col(c) for c in stamped.columns], "__before")
    past = F.transform("__before", lambda s: s["v"])
    return out.withColumn("previous", F.coalesce(past, F.array().cast(out.select(past.alias("p")).schema[0].dataType))).drop("__t", "__before")


def retry_state(attempts: DataFrame, key: str = "game_id") -> DataFrame:
    """n_failures, last attempt and next retry per key from an append-only log of failures (key, at)."""
    n = F.count("*")
    delay = F.element_at(F.array(*[F.lit(x) for x in RETRY_SECONDS]), F.least(n, F.lit(len(RETRY_SECONDS))).cast("int"))
    return attempts.groupBy(key).agg(n.alias("n_failures"), F.max("at").alias("last_at"), delay.alias("delay_seconds")).withColumn("next_at", F.col("last_at") + F.make_dt_interval(secs=F.col("delay_seconds")))


def missing_evidence(games: DataFrame, payloads: DataFrame, attempts: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Games without a payload that are due: never tried, or their retry time has come; untried first, then the oldest."""
    state = retry_state(attempts)
    due = games.join(payloads.select("game_id").distinct(), "game_id", "left_anti").join(state, "game_id", "left").where(F.col("next_at").isNull() | (F.col("next_at") <= now))
    out = due.select("game_id", "creation", F.coalesce("n_failures", F.lit(0)).alias("n_failures"), "next_at")
    return out.orderBy("n_failures", F.desc("creation"), F.desc("game_id")).limit(limit) if limit else out


def fetch_due(games: DataFrame, payloads: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """(game_id, n_failures, next_at, due) of every game: due without a payload if never tried or its retry time has come."""
    state = retry_state(attempts).select("game_id", "n_failures", "next_at")
    there = payloads.select("game_id").distinct().withColumn("__has", F.lit(True))
    d = games.select("game_id").join(there, "game_id", "left").join(state, "game_id", "left")
    due = F.col("__has").isNull() & (F.col("next_at").isNull() | (F.col("next_at") <= now))
    return d.select("game_id", F.coalesce("n_failures", F.lit(0)).alias("n_failures"), "next_at", due.alias("due"))


def set_differences(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): what is required and not there (missing), and there without being required (unknown)."""
    missing = required.select(*keys).distinct().join(present.select(*keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(present.select(*keys).distinct().join(required.select(*keys), keys, "left_anti").withColumn("problem", F.lit("unknown")))


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key (content hash) is not there yet, one for each key."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """All keys with the newest row of each; equal stamps take the incoming one."""
    both = existing.withColumn("__in", F.lit(0)).unionByName(incoming.withColumn("__in", F.lit(1)))
    return latest(both, keys, [stamp, "__in"]).drop("__in")


def same_members(stored: DataFrame, submitted: DataFrame, key: str = "game_id", member: str = "participant_id") -> DataFrame:
    """Keys whose submitted members are exactly the stored ones, without repeats."""
    a = stored.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("a"))
    b = submitted.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("b"))
    return a.join(b, key).where("a = b").select(key)
