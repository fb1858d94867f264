"""The fixed queries of the case graph; each takes frames and plain parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_label(entity: DataFrame, query: str, kind: str | None = None, limit: int = 12) -> DataFrame:
    """Entities whose label holds query (case counts), of one type if given; surest first."""
    hit = F.col("label").contains(query)
    if kind is not None:
        hit = hit & (F.col("entity_type") == kind)
    return entity.where(hit).orderBy(F.desc("confidence"), "id").limit(limit).select("id", "label", "entity_type", "confidence", "source_url")


def by_type(entity: DataFrame, kind: str, limit: int = 12) -> DataFrame:
    return entity.where(F.col("entity_type") == kind).orderBy("label", "id").limit(limit).select("id", "label", "confidence", "source_url")


def joined(edge: DataFrame, entity: DataFrame) -> DataFrame:
    """Edges with their ends' labels and sources."""
    a = entity.select(F.col("id").alias("source_id"), F.col("label").alias("src"), F.col("source_url").alias("source_a"))
    b = entity.select(F.col("id").alias("target_id"), F.col("label").alias("tgt"), F.col("source_url").alias("source_b"))
    return edge.drop("source_url").join(a, "source_id").join(b, "target_id")


def inferred(edge: DataFrame) -> Column:
    return F.col("provenance").eqNullSafe("inferred")


def extracted_edges(edge: DataFrame, entity: DataFrame) -> DataFrame:
    return joined(edge.where(~inferred(edge)), entity).select("src", "edge_type", "tgt", "provenance", "confidence")


def inferred_edges(edge: DataFrame, entity: DataFrame) -> DataFrame:
    return joined(edge.where(inferred(edge)), entity).select("src", "edge_type", "tgt", "confidence", "evidence")


def ownership_edges(edge: DataFrame) -> DataFrame:
    return edge.where((F.col("edge_type") == "OWNS") & ~inferred(edge)).select("source_id", "target_id", "share_pct")


def money_edges(edge: DataFrame, kinds: tuple[str, ...] = ("FUNDED_BY", "PAID_TO")) -> DataFrame:
    return edge.where(F.col("edge_type").isin(*kinds) & (F.col("amount") > 0)).select("source_id", "target_id", "edge_type", "amount", "currency")


def contradictions(edge: DataFrame, entity: DataFrame, limit: int = 20) -> DataFrame:
    """Pairs of claims that contradict each other, newest first."""
    found = joined(edge.where("edge_type = 'CONTRADICTS'"), entity)
    return found.orderBy(F.desc("created_at"), "source_id", "target_id").limit(limit).select(F.col("src").alias("claim_a"), F.col("tgt").alias("claim_b"), "source_a", "source_b", F.col("created_at").alias("found_at"))


def counted(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def new_since(entity: DataFrame, since: int) -> DataFrame:
    return counted(entity.where(F.col("created_at") > since), "entity_type")


def unlinked(entity: DataFrame, edge: DataFrame, mention: DataFrame, before: int | None = None) -> DataFrame:
    """Entities without an edge in either direction and without a mention, older than before if given."""
    ends = edge.select(F.col("source_id").alias("id")).union(edge.select("target_id"))
    old = entity if before is None else entity.where(F.col("created_at") < before)
    return old.join(ends, "id", "left_anti").join(mention.select(F.col("entity_id").alias("id")), "id", "left_anti").select("id", "label", "entity_type")


def from_llm(frame: DataFrame) -> DataFrame:
    return frame.where("extraction_source = 'llm'")


def low_confidence(entity: DataFrame, least: float = 0.6) -> DataFrame:
    return entity.where(F.col("confidence") < least).select("id", "label", "entity_type", "confidence")


def needs_review(entity: DataFrame) -> DataFrame:
    return entity.where("quality_flag = 'needs_review'").select("id", "label", "entity_type", "created_at")


def junk(entity: DataFrame) -> DataFrame:
    """Concepts named like work records."""
    label = F.col("label")
    odd = label.contains("Session") | label.contains("Commit") | label.contains("File") | label.rlike(r"\d{4}-\d{2}-\d{2}")
    return entity.where((F.col("entity_type") == "concept") & odd).select("id", "label")


def at(edge: DataFrame, moment: int) -> DataFrame:
    """Edges known at a moment: created by then, and not expired by then (0 or null: never)."""
    gone = F.coalesce(F.nullif(F.col("expired_at"), F.lit(0)), F.lit(2**62))
    return edge.where((F.col("created_at") <= moment) & (gone > moment))


def expire(edge: DataFrame, which: Column, moment: int) -> DataFrame:
    """A soft delete: the edges that match end at the moment, unless they ended before."""
    return edge.withColumn("expired_at", F.when(which & (F.coalesce("expired_at", F.lit(0)) == 0), F.lit(moment)).otherwise(F.col("expired_at")))
