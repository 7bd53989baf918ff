"""Joins of many rows to one row per key, when a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 4096


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], deal: str, n: str = "n") -> DataFrame:
    """``rows`` inner-joined to ``counted``, which has one row per key and in ``n`` the key's rows, and is read three times.

    A key with more than 1/SLICES of all counted rows is dealt over tasks by the hash of ``deal``, each slice with its own
    copy of the key's row. Such keys are fewer than SLICES at every size, so their list is broadcast. Null keys join nothing.
    """
    total = counted.agg(F.sum(n)).first()[0] or 1
    slices = F.ceil(F.col(n) * SLICES / F.lit(total)).cast("int")
    hot = counted.where(slices > 1).select(*keys, slices.alias("__slices"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__slice", F.pmod(F.xxhash64(deal), F.coalesce("__slices", F.lit(1))).cast("int")).drop("__slices")
    copies = counted.withColumn("__slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return dealt.join(copies.hint("merge"), [*keys, "__slice"]).drop("__slice")
