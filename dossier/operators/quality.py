"""Measures: precision and recall, B-Cubed, quarantine, health of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prf(found: DataFrame, gold: DataFrame, keys: list[str], empty: float = 1.0) -> DataFrame:
    """One row: precision, recall, f1 over distinct rows; empty is what a share of nothing counts."""
    a, b = found.select(*keys).distinct(), gold.select(*keys).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full_outer").agg(F.count("_a").alias("na"), F.count("_b").alias("nb"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n"))
    p, r = F.when(F.col("na") == 0, empty).otherwise(F.col("n") / F.nullif("na", F.lit(0))), F.when(F.col("nb") == 0, empty).otherwise(F.col("n") / F.nullif("nb", F.lit(0)))
    return both.select(p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def bcubed(clusters: DataFrame) -> DataFrame:
    """One row of B-Cubed precision, recall, f1; clusters: id, cluster, gold. Counts of cells, not pairs of items (Bagga and Baldwin 1998)."""
    cell = clusters.groupBy("cluster", "gold").agg(F.count(F.lit(1)).alias("n"))
    c, g = cell.groupBy("cluster").agg(F.sum("n").alias("nc")), cell.groupBy("gold").agg(F.sum("n").alias("ng"))
    parts = cell.join(c, "cluster").join(g, "gold")
    sums = parts.agg((F.sum(F.col("n") * F.col("n") / F.col("nc")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / F.sum("n")).alias("recall"))
    return sums.select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 9).alias("f1"))


def quarantine(every: DataFrame, kept: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(kind, total, quarantined, rate)."""
    marked = every.join(kept.select(*keys).distinct().withColumn("_k", F.lit(True)), keys, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("_k").isNull(), 1)).alias("quarantined")).select(
        F.lit(kind).alias("kind"), "total", "quarantined", F.round(F.col("quarantined") / F.nullif("total", F.lit(0)), 6).alias("rate")
    )


def health(entity: DataFrame, edge: DataFrame, types: list[str], edge_types: list[str]) -> DataFrame:
    """One row: share of types in use (icr), of the largest type (ci), of edge types in use (ipr), each with its band."""
    band = lambda v, good, fair: F.when(v >= good, "good").when(v >= fair, "fair").otherwise("poor")
    by_type = entity.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.when(F.col("entity_type").isin(*types), 1)).alias("used"), F.max("n").alias("most"), F.sum("n").alias("total"))
    by_edge = edge.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.when(F.col("edge_type").isin(*edge_types), 1)).alias("used_edges"))
    row = by_type.join(F.broadcast(by_edge)).select(F.round(F.col("used") / len(types), 6).alias("icr"), F.round(F.col("most") / F.col("total"), 6).alias("ci"), F.round(F.col("used_edges") / len(edge_types), 6).alias("ipr"))
    return row.select("icr", band(F.col("icr"), 0.8, 0.5).alias("icr_band"), "ci", F.when(F.col("ci") <= 0.3, "good").when(F.col("ci") <= 0.5, "fair").otherwise("poor").alias("ci_band"), "ipr", band(F.col("ipr"), 0.8, 0.5).alias("ipr_band"))


def triples(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Macro averages over sentences of exact-triple precision, recall and f1; both: sid, s, t, o."""
    keys = ["sid", "s", "t", "o"]
    a, b = found.select(*keys).distinct().withColumn("_a", F.lit(1)), gold.select(*keys).distinct().withColumn("_b", F.lit(1))
    per = a.join(b, keys, "full_outer").groupBy("sid").agg(F.count("_a").alias("na"), F.count("_b").alias("nb"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n"))
    p, r = F.coalesce(F.try_divide("n", "na"), F.lit(0.0)), F.coalesce(F.try_divide("n", "nb"), F.lit(0.0))
    per = per.select(p.alias("p"), r.alias("r")).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    return per.agg(F.round(F.avg("p"), 9).alias("precision"), F.round(F.avg("r"), 9).alias("recall"), F.round(F.avg("f"), 9).alias("f1"), F.count(F.lit(1)).alias("sentences"))
