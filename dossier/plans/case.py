"""From raw records to the graph: ground, rescue, resolve, re-point, merge, build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import ground as R
from dossier.operators import merge as M
from dossier.operators import resolve as Z
from dossier.operators import store as T
from dossier.session import materialise

MULTIFIELD = ("reg_id", "address", "jurisdiction")


@dataclass
class Resolved:
    entity: DataFrame
    edge: DataFrame
    id_map: DataFrame
    merges: DataFrame
    pair_review: DataFrame | None
    edge_review: DataFrame
    quarantined: dict[str, DataFrame]


def ground_and_resolve(chunk: DataFrame, entity: DataFrame, edge: DataFrame, least: int = 1, fuzzy: float = Z.FUZZY, cosine: float = Z.COSINE, cosine_policy: str = "auto", structured: tuple[str, ...] = ("structured",), decide: Callable[[DataFrame], DataFrame] | None = None, probabilistic: bool = False, more: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> Resolved:
    """Entities and edges that the chunks support, or that structured sources tie to such, resolved and merged.

    Tiers: rows with a register number, address or jurisdiction resolve by these alone; the others by
    exact name, then, in a batch without structured rows, by spelling, then by vectors if there are
    any (cosine_policy 'auto' merges, 'review' doesn't), then, in a batch with structured rows, by name
    key; then by probabilities if asked, and by what tiers there are more. decide(pairs) says which of the
    spellings just below the threshold are one. Entities linked by ALIAS_OF are one. entity: id, entity_type, label, extraction_source, ord
    and optional embedding, reg_id, address, jurisdiction; edge: source_id, target_id, edge_type, ord.
    """
    found = materialise(R.mentions(entity, chunk), "mentions")
    grounded = R.ground_entities(entity, found)
    kept = materialise(grounded.unionByName(R.rescue_entities(entity, grounded, structured)), "kept")
    tied = R.ground_edges(edge, found, least)
    edges = materialise(tied.unionByName(R.rescue_edges(edge, kept, structured)).dropDuplicates(["ord"]), "tied")
    quarantined = {"entity": entity.join(kept.select("id"), "id", "left_anti"), "edge": edge.join(edges.select("ord"), "ord", "left_anti")}

    have = [c for c in MULTIFIELD if c in kept.columns]
    multi = Z.has_fields(kept)
    by_fields, by_names = kept.where(multi), kept.where(~multi)
    batch = not kept.where(F.col("extraction_source").isin(*structured)).isEmpty()
    steps = [Z.exact]
    if not batch and decide is None:
        steps.append(lambda e: Z.greedy(e, Z.fuzzy_pairs(e, fuzzy)))
    elif not batch:
        steps.append(lambda e: Z.greedy(e, Z.adjudicate(Z.fuzzy_pairs(e, fuzzy - Z.ADJUDICATE), fuzzy, decide)[0]))
    if "embedding" in kept.columns and cosine_policy == "auto":
        steps.append(lambda e: Z.greedy(e, Z.cosine_pairs(e, cosine)))
    if batch:
        steps.append(Z.by_name)
    if probabilistic:
        steps.append(Z.fellegi_sunter)
    steps += more
    ids = Z.tiers(by_names, *steps)
    review = None
    if have and not by_fields.isEmpty():
        fields = by_fields.select("*", *[F.lit(None).cast("string").alias(c) for c in MULTIFIELD if c not in have])
        own, decided, _ = Z.multifield(fields)
        ids, review = ids.union(own), decided.where("decision = 'review'")
    standing = kept.join(ids.where("id = canonical").select("id"), "id", "left_semi")
    alias = Z.alias(standing, M.repoint(edges, ids)).select(F.col("id").alias("canonical"), F.col("canonical").alias("_a"))
    ids = materialise(ids.join(alias, "canonical", "left").select("id", F.coalesce("_a", "canonical").alias("canonical")), "ids")
    canonical = kept.join(ids.where("id = canonical").select("id"), "id", "left_semi")
    written, edge_review = M.plan(M.repoint(edges.where("edge_type <> 'ALIAS_OF'"), ids))
    return Resolved(canonical, written, ids, Z.merge_records(kept, ids, "cascade"), review, edge_review, quarantined)


def rebuild(chunk: DataFrame, entity: DataFrame, edge: DataFrame, document: DataFrame, mention: DataFrame, **options) -> tuple[dict[str, DataFrame], DataFrame]:
    """The graph's tables and counts from stored records; the same call serves a first build."""
    r = ground_and_resolve(chunk, entity, edge, **options)
    there = mention.join(r.id_map.select(F.col("id").alias("entity_id"), "canonical"), "entity_id").select(F.col("canonical").alias("entity_id"), "doc_id", "mention_count")
    there = there.groupBy("entity_id", "doc_id").agg(F.sum("mention_count").alias("mention_count"))
    return T.build(r.entity, r.edge, document, there)
