"""Connected components of an edge table, as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import discard, materialise

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then all components are stars around their smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg((F.sum("up") + F.max("down")).alias("n")).where("n > 1").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al. 2014): the number of rounds grows with the
    logarithm of the component sizes, not with their diameter. A node's smallest neighbour is a
    partially summed aggregate and is joined back, so no task collects the neighbours of a hub.
    Each round is written to the shared folder, which cuts the lineage; stars need none. Loops and nulls
    are ignored; isolated nodes are not in the result.
    """
    a, b = F.col(src), F.col(dst)
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialise(now, "cc")
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low, F.col("u") == F.col("k"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        after = materialise(small, "cc")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    # Every node but the root of its component now points to the root.
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
