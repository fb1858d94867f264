"""Lossless merging: edges that meet after entities were merged are summed, kept or sent to review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "target_id", "edge_type"]
ADDITIVE = ("amount", "amount_total", "contribution_count")
DATA = (*ADDITIVE, "dates", "currency", "share_pct")


def edge_key(edge: DataFrame) -> DataFrame:
    """edge with key, which says when two edges are one."""
    return edge.withColumn("key", F.concat_ws("|", *KEY))


def data_props(edge: DataFrame) -> DataFrame:
    """edge with data, a map of what may conflict: the names and values of its data columns that aren't null."""
    there = [c for c in DATA if c in edge.columns]
    both = F.array(*[F.struct(F.lit(c).alias("key"), F.to_json(F.struct(c)).alias("value")) for c in there])
    return edge.withColumn("data", F.map_from_entries(F.filter(both, lambda x: x["value"] != "{}")))


def repoint(edge: DataFrame, id_map: DataFrame) -> DataFrame:
    """Both ends replaced by their canonical ids (id_map: id, canonical; itself if absent); loops fall away."""
    a, b = id_map.select(F.col("id").alias("source_id"), F.col("canonical").alias("ca")), id_map.select(F.col("id").alias("target_id"), F.col("canonical").alias("cb"))
    out = edge.join(a, "source_id", "left").join(b, "target_id", "left")
    out = out.withColumn("source_id", F.coalesce("ca", "source_id")).withColumn("target_id", F.coalesce("cb", "target_id")).drop("ca", "cb")
    return out.where("source_id <> target_id").select(*edge.columns)


def classify(edge: DataFrame) -> DataFrame:
    """One row for each key: n, bucket (safe, reaggregated, review) and reason.

    One edge, or several with the same data, is safe; more than one currency or share is for review
    (blank currencies don't count, though they make edges differ); all else is summed.
    """
    have = [c for c in DATA if c in edge.columns]
    data = F.to_json(F.struct(*have)) if have else F.lit("")
    g = edge.withColumn("_data", data).groupBy(*KEY)
    kinds = F.count_distinct(F.nullif(F.trim("currency"), F.lit(""))) if "currency" in have else F.lit(0)
    shares = F.count_distinct("share_pct") if "share_pct" in have else F.lit(0)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_data").alias("_kinds"), kinds.alias("_cur"), shares.alias("_shares"))
    reason = F.when((F.col("_kinds") > 1) & (F.col("_cur") > 1), "currency_mismatch").when((F.col("_kinds") > 1) & (F.col("_shares") > 1), "non_additive_conflict:share_pct")
    bucket = F.when(reason.isNotNull(), "review").when(F.col("_kinds") > 1, "reaggregated").otherwise("safe")
    return out.select(*KEY, "n", bucket.alias("bucket"), reason.alias("reason"))


def plan(edge: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(edges to write, edges for review with their reason). The first edge in order stands for its key.

    Sums are taken in DECIMAL, so they don't depend on the order of addition; dates are united in
    order of first sight.
    """
    kinds = classify(edge).drop("n")
    tagged = edge.join(kinds, KEY)
    review = tagged.where("bucket = 'review'").drop("bucket")
    rest = tagged.where("bucket <> 'review'").drop("reason")
    sums = []
    for c in ADDITIVE:
        if c in edge.columns:
            total = F.sum(F.col(c).cast("decimal(28,4)")).cast(edge.schema[c].dataType)
            sums.append(F.when(F.first("bucket") == "reaggregated", total).otherwise(F.min_by(c, order)).alias(c))
    if "dates" in edge.columns:
        seen = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("dates")))), lambda x: F.coalesce(x["dates"], F.array().cast(edge.schema["dates"].dataType)))))
        sums.append(F.when(F.count("dates") > 0, seen).alias("dates"))
    if "currency" in edge.columns:
        sums.append(F.coalesce(F.max(F.nullif(F.trim("currency"), F.lit(""))), F.min_by("currency", order)).alias("currency"))
    done = {*KEY, *ADDITIVE, "dates", "currency"}
    keep = [F.min_by(c, order).alias(c) for c in edge.columns if c not in done]
    return rest.groupBy(*KEY).agg(*sums, *keep).select(*edge.columns), review


def first_seen(frame: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return frame.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
