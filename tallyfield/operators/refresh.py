"""Incremental maintenance of scores: a change log, high-water marks and tables whose partitions are replaced.

Evidence arrives in an append-only table; a change log says which game each arrival concerns, numbered per source. A refresh
takes the log between the stored marks and its newest numbers, recomputes only the games named there, replaces only the
partitions that hold them, appends runs that are not there yet, and moves the active run of these games, which never goes
to a weaker tier. Marks are written last: a refresh that dies is done again and leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import features, history, models
from tallyfield.session import stored

BUCKETS = 64


@dataclass(frozen=True)
class GameStore:
    """Tables in one folder, partitioned by a bucket of game_id."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("game_id"), F.lit(self.buckets)).cast("int")

    def create(self, name: str, schema: str) -> None:
        """An empty table, if there is none yet."""
        empty = self.spark.createDataFrame([], f"{schema}, bucket int")
        empty.write.mode("ignore").partitionBy("bucket").parquet(f"{self.root}/{name}")

    def read(self, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """The table, or only its partitions ``only``; other partitions are not opened."""
        rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.root}/{name}")
        return rows if only is None else rows.where(F.col("bucket").isin(only)) if only else rows.where(F.lit(False))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/{name}")

    def replace(self, name: str, schema: str, rows: DataFrame, changed: DataFrame, only: list[int]) -> None:
        """``rows`` instead of all rows of the games ``changed``, whose buckets are ``only``; every changed game has a row."""
        kept = self.read(name, schema, only).drop("bucket").join(changed, "game_id", "left_anti")
        new = stored(kept.unionByName(rows.select(*kept.columns)), f"new-{name}")  # no partition is read while it is replaced
        new.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")


EVIDENCE = "game_id long, source string, seq long, completeness double, item long"
ACTIVE = "game_id long, status string, run_id string, tier string, model_version int, created_at long"
RUNS = "game_id long, run_id string, tier string, model_version int, created_at long, completeness double, participant_id int, score double, model_rank int, rank_confidence double"
_LOG = "source string, seq long, game_id long"


class EvidenceRefresh:
    """Runs refreshes of one store. ``artifacts`` maps a tier to (model version, coefficients); tiers without one are not scored."""

    def __init__(self, spark: SparkSession, root: str, artifacts: dict[str, tuple[int, dict[str, float]]], scale: float = 2.0, buckets: int = BUCKETS) -> None:
        self.store = GameStore(spark, root, buckets)
        self.artifacts, self.scale, self.spark, self.root = artifacts, scale, spark, root
        for name, schema in (("evidence", EVIDENCE), ("active", ACTIVE), ("runs", RUNS)):
            self.store.create(name, schema)
        spark.createDataFrame([], _LOG).write.mode("ignore").partitionBy("source").parquet(f"{root}/log")
        spark.createDataFrame([], "source string, mark long").write.mode("ignore").parquet(f"{root}/marks")

    def land(self, arrivals: DataFrame) -> None:
        """Appends evidence (game_id, source, seq, completeness, item) and then its changes."""
        arrivals = stored(arrivals.select("game_id", "source", "seq", "completeness", "item"), "arrivals")
        self.store.append("evidence", arrivals)
        arrivals.select("source", "seq", "game_id").distinct().write.mode("append").partitionBy("source").parquet(f"{self.root}/log")

    def marks(self) -> dict[str, int]:
        """The newest number that was worked in, for each source that is a tier."""
        rows = self.spark.read.schema("source string, mark long").parquet(f"{self.root}/marks").where(F.col("source").isin(*features.TIERS)).groupBy("source").agg(F.max("mark").alias("mark"))
        return {r.source: r.mark for r in rows.collect()}

    def changes(self) -> tuple[DataFrame, dict[str, int]]:
        """Games named in the log beyond the marks and up to its newest numbers, and these numbers."""
        log = self.spark.read.schema(_LOG).parquet(f"{self.root}/log").where(F.col("source").isin(*features.TIERS))
        newest = {r.source: r.seq for r in log.groupBy("source").agg(F.max("seq").alias("seq")).collect()}
        marks = self.marks()
        fresh = F.lit(False)
        for source, top in newest.items():
            past = F.col("seq") > marks[source] if source in marks else F.lit(True)
            fresh = fresh | ((F.col("source") == source) & past & (F.col("seq") <= top))
        return log.where(fresh & F.col("game_id").isNotNull()).select("game_id").distinct(), newest

    def refresh(self, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """One refresh; ``rows_of`` gives the feature rows (game_id, participant_id, role, features) of some games.

        Returns the changed games with their status: scored, no_artifact (no tier with a model has evidence) or no_rows.
        """
        found, newest = self.changes()
        changed = stored(found, "changed")
        only = sorted(r.bucket for r in changed.select(self.store.bucket().alias("bucket")).distinct().collect())  # at most ``buckets``
        evidence = self.store.read("evidence", EVIDENCE, only).join(changed, "game_id", "left_semi")
        runs = stored(self._runs(self._routed(evidence, newest), rows_of(changed)), "runs")
        old = self.store.read("runs", RUNS, only).select("game_id", "run_id").distinct()
        self.store.append("runs", runs.join(old, ["game_id", "run_id"], "left_anti"))

        held = self.store.read("active", ACTIVE, only).join(changed, "game_id", "left_semi").where("run_id is not null").select("game_id", "run_id", "tier", "model_version", "created_at")
        heads = runs.select("game_id", "run_id", "tier", "model_version", "created_at").distinct()
        best = history.active_runs(held.unionByName(heads))
        known = changed.join(best, "game_id", "left").join(rows_of(changed).select("game_id").distinct().withColumn("has", F.lit(True)), "game_id", "left")
        status = F.when(F.col("has").isNull(), "no_rows").when(F.col("run_id").isNull(), "no_artifact").otherwise("scored")
        done = stored(known.withColumn("status", status).drop("has"), "refreshed")
        self.store.replace("active", ACTIVE, done, changed, only)
        self.spark.createDataFrame(list(newest.items()), "source string, mark long").write.mode("append").parquet(f"{self.root}/marks")
        return done.select("game_id", "status", "run_id")

    def _routed(self, evidence: DataFrame, newest: dict[str, int]) -> DataFrame:
        """(game_id, tier, completeness, created_at): the best tier with a model, from the newest evidence of each tier."""
        known = evidence.where(F.col("source").isin(*self.artifacts))
        last = known.groupBy("game_id", F.col("source").alias("tier")).agg(F.max_by("completeness", F.struct("seq", "item")).alias("completeness"))
        whole = evidence.groupBy("game_id").agg(F.lit("aggregate").alias("tier"), F.lit(1.0).alias("completeness"))
        every = last.where("tier != 'aggregate'").unionByName(whole) if "aggregate" in self.artifacts else last
        stamp = evidence.groupBy("game_id").agg(F.max("seq").alias("created_at"))
        return features.best_tier(every).join(stamp, "game_id")

    def _runs(self, routed: DataFrame, rows: DataFrame) -> DataFrame:
        """Scored participants of each game; the id of a run is the hash of what went into it."""
        raw, version = F.lit(0.0), F.lit(0)
        for tier, (number, coefficients) in self.artifacts.items():
            raw = F.when(F.col("tier") == tier, models.linear_score(coefficients)).otherwise(raw)
            version = F.when(F.col("tier") == tier, number).otherwise(version)
        names = sorted({f for _, coefficients in self.artifacts.values() for f in coefficients})
        scored = models.score_model(rows.join(routed, "game_id"), raw, names, {}, self.scale, completeness="completeness")
        scored = scored.withColumn("model_version", version)
        run = F.sha2(F.concat_ws("|", "game_id", "tier", "model_version", "completeness"), 256)
        return scored.withColumns({"run_id": run, "participant_id": F.col("participant_id").cast("int")}).select("game_id", "run_id", "tier", "model_version", "created_at", "completeness", "participant_id", "score", "model_rank", "rank_confidence")

    def active_scores(self) -> DataFrame:
        """The scores of every game's active run."""
        runs = self.store.read("runs", RUNS).drop("bucket")
        return runs.join(self.store.read("active", ACTIVE).where("run_id is not null").select("game_id", "run_id"), ["game_id", "run_id"])
