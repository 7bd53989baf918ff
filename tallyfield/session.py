"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tallyfield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: ANSI on, AQE on, UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Rows reach Python tasks in batches of at most ``most`` bytes, or what the session already has if that is less.

    The session's usual 64 MB are held twice for every running task, in the executor and in its Python worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local session may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyfield-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which lasts until ``release`` or the end of the program."""
    path = f"{checkpoint_root(spark)}/tallyfield/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_at_exit)
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Removes what this program has put in the shared folder so far, and says how many paths that were.

    For long programs, once the results so far are written: DataFrames that were made before can no longer be read.
    """
    made, _MADE[:] = [*_MADE], []
    for path in made:
        for p in (path, f"{path}-state"):  # a stream's own state stands beside what it wrote
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)


def _at_exit() -> None:
    """Without a session there is nobody left to ask; then the folder's owner has to clear it."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: short lineage that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` after a reliable checkpoint, which Spark removes when nothing refers to it any more."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
