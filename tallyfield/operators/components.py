"""Connected components with the smallest node as label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import cut


def _print(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that ``edges`` names; component is the smallest node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al. 2014): edges only shrink towards smaller nodes, hubs are
    handled by aggregates and joins and never gathered in one task, and long chains halve with each round. Each round is
    checkpointed. Null ends are ignored; a loop makes its node its own component unless other edges say otherwise.
    """
    a, b = F.col(src), F.col(dst)
    named = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    loops = named.where("u = v").select("u", "v").distinct()
    now = cut(named.where("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now points from a node to a smaller one
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u > v")
            .distinct()
        )
        now = cut(small)
        shape = _print(now)
        if shape == seen:
            break
        seen = shape
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label: Column = F.min("v")
    members = now.groupBy("u").agg(label.alias("v"))
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return members.union(roots).union(loops).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
