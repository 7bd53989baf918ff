"""Keyset paging: pages by seeking past a cursor in a table that is laid out in the order of its keys.

The table is written in parts of about ``rows_per_part`` rows by ranges of (first key, second key), largest first, with a small list
of what each part holds. A page looks up in that list which parts follow the cursor and reads only those, so it costs
the same wherever it is, and no row before it is counted or skipped. Keys are whole numbers; null keys come last. The pair of keys
names a row: rows that share both are on the same side of every cursor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LAST = -(1 << 63)
_LIST = "part int, most_first long, most_second long, least_first long, least_second long, rows long"


@dataclass(frozen=True)
class KeysetTable:
    spark: SparkSession
    path: str
    schema: StructType

    @classmethod
    def write(cls, rows: DataFrame, first: Column, second: Column, path: str, rows_per_part: int = 1_000_000) -> KeysetTable:
        """Lays out ``rows`` by descending keys. Two jobs besides the count; nothing is collected."""
        spark = rows.sparkSession
        keyed = rows.withColumns({"k1": F.coalesce(first.cast("long"), F.lit(LAST)), "k2": F.coalesce(second.cast("long"), F.lit(LAST))})
        order = [F.desc("k1"), F.desc("k2")]
        parts = max(1, -(-rows.count() // rows_per_part))
        placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        placed.write.partitionBy("part").parquet(f"{path}/rows")
        written = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        most, least = F.max(F.struct("k1", "k2")).alias("most"), F.min(F.struct("k1", "k2")).alias("least")
        listed = written.groupBy("part").agg(most, least, F.count("*").alias("rows"))
        listed.select(F.col("part").cast("int"), "most.k1", "most.k2", "least.k1", "least.k2", "rows").toDF(*[c.strip().split(" ")[0] for c in _LIST.split(",")]).write.parquet(f"{path}/list")
        return cls(spark, path, placed.schema)

    def _parts(self, after: tuple[int, int] | None, n: int) -> list[int]:
        """The parts that hold the next ``n`` rows: the one around the cursor, and then as many as are needed."""
        listed = self.spark.read.schema(_LIST).parquet(f"{self.path}/list")
        if after:
            listed = listed.where((F.col("least_first") < after[0]) | ((F.col("least_first") == after[0]) & (F.col("least_second") < after[1])))
        out, sure = [], 0
        for r in listed.orderBy(F.desc("most_first"), F.desc("most_second")).limit(n + 1).collect():  # a part has a row at least
            out.append(r.part)
            sure += r.rows if out[1:] or not after else 0  # of the first part only some rows may follow
            if sure >= n:
                break
        return out

    def page(self, after: tuple[int, int] | None = None, n: int = 25) -> DataFrame:
        """The next rows after the cursor in order, 1 to 100 of them, with their keys k1 and k2; the last row's are the next cursor."""
        n = min(100, max(1, n))
        parts = self._parts(after, n)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").where(F.col("part").isin(parts) if parts else F.lit(False))
        if after:
            rows = rows.where((F.col("k1") <= after[0]) & ((F.col("k1") < after[0]) | (F.col("k2") < after[1])))
        return rows.drop("part").orderBy(F.desc("k1"), F.desc("k2")).limit(n)
