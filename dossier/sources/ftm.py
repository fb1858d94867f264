"""Exchange with the FollowTheMoney model: proxies out and in, with a ledger of what has no place there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Schemata and properties of the FollowTheMoney model.
ENTITY = {"person": "Person", "organization": "Company", "location": "Address", "asset": "Asset", "document": "Document", "event": "Event"}
SCHEMA = {
    "Person": "person", "Company": "organization", "Organization": "organization", "PublicBody": "organization", "LegalEntity": "organization", "Address": "location",
    "Asset": "asset", "RealEstate": "asset", "Security": "asset", "Vehicle": "asset", "Document": "document", "Event": "event",
}
EDGE = {
    "OWNS": ("Ownership", "owner", "asset"), "FUNDED_BY": ("Payment", "payer", "beneficiary"), "EMPLOYED_BY": ("Employment", "employee", "employer"),
    "BOARD_MEMBER_OF": ("Directorship", "director", "organization"), "MEMBER_OF": ("Membership", "member", "organization"), "FAMILY_OF": ("Family", "person", "relative"),
}
LOOSE = ("ASSOCIATED_WITH", "OPERATED_BY", "REGISTERED_AGENT_OF", "IMPERSONATES", "SIBLING_OF", "CO_HOSTED_WITH", "OPERATES_DOMAIN")
PROPERTIES = "map<string,array<string>>"


def _lookup(table: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def export(entity: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proxies: id, schema, properties; dropped: kind, item, reason). Nothing is lost without a ledger row."""
    kind = F.try_element_at(_lookup(ENTITY), F.col("entity_type"))
    ents = entity.select("id", "entity_type", "label", kind.alias("schema"))
    name = F.when(F.coalesce("label", F.lit("")) != "", F.create_map(F.lit("name"), F.array("label"))).otherwise(F.create_map().cast(PROPERTIES))
    proxies = ents.where("schema is not null").select("id", "schema", name.alias("properties"))
    e = edge.select("source_id", "target_id", "edge_type", *[F.col(c).cast("string").alias(c) if c in edge.columns else F.lit(None).cast("string").alias(c) for c in ("share_pct", "amount", "currency")])
    at = lambda i: F.try_element_at(_lookup({k: v[i] for k, v in EDGE.items()}), F.col("edge_type"))
    loose = F.col("edge_type").isin(*LOOSE)
    e = e.select("*", F.when(loose, "UnknownLink").otherwise(at(0)).alias("schema"), F.when(loose, "subject").otherwise(at(1)).alias("sp"), F.when(loose, "object").otherwise(at(2)).alias("tp"))

    def extra(column: str, prop: str, kinds: str):
        have = (F.col("edge_type") == kinds) & ~F.coalesce(F.col(column), F.lit("")).isin("", "0", "0.0")
        return F.when(have, F.create_map(F.lit(prop), F.array(column))).otherwise(F.create_map().cast(PROPERTIES))

    role = F.when(loose, F.create_map(F.lit("role"), F.array("edge_type"))).otherwise(F.create_map().cast(PROPERTIES))
    props = F.map_concat(F.create_map("sp", F.array("source_id"), "tp", F.array("target_id")), role, extra("share_pct", "percentage", "OWNS"), extra("amount", "amount", "FUNDED_BY"), extra("currency", "currency", "FUNDED_BY"))
    links = e.where("schema is not null").select(F.concat_ws(":", "edge_type", "source_id", "target_id").alias("id"), "schema", props.alias("properties"))
    dropped = ents.where("schema is null").select(F.lit("entity").alias("kind"), F.col("id").alias("item"), F.concat(F.lit("no schema for type "), "entity_type").alias("reason"))
    lost = e.where("schema is null").select(F.lit("edge").alias("kind"), F.concat("source_id", F.lit("-"), "edge_type", F.lit("->"), "target_id").alias("item"), F.concat(F.lit("no schema for edge "), "edge_type").alias("reason"))
    return proxies.union(links), dropped.union(lost)


def load(proxies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, dropped) of proxies (id, schema, properties); each keeps its own source."""
    first = lambda p: F.get(F.try_element_at("properties", F.lit(p)), F.lit(0))
    prov = F.coalesce(F.nullif(F.coalesce(first("sourceUrl"), first("publisher")), F.lit("")), F.lit("ftm_import")).alias("provenance")
    kind = F.try_element_at(_lookup(SCHEMA), F.col("schema"))
    back = {v[0]: (k, v[1], v[2]) for k, v in EDGE.items()} | {"UnknownLink": ("", "subject", "object")}
    at = lambda i: F.try_element_at(_lookup({k: v[i] for k, v in back.items()}), F.col("schema"))
    is_edge = F.col("schema").isin(*back)
    entities = proxies.where(kind.isNotNull()).select("id", kind.alias("entity_type"), first("name").alias("label"), prov, F.lit("ftm_import").alias("extraction_source"))
    end = lambda i: F.get(F.try_element_at("properties", at(i)), F.lit(0))
    edges = proxies.where(is_edge).select(
        end(1).alias("source_id"), end(2).alias("target_id"), F.when(F.col("schema") == "UnknownLink", F.coalesce(first("role"), F.lit("ASSOCIATED_WITH"))).otherwise(at(0)).alias("edge_type"),
        first("percentage").alias("share_pct"), first("amount").alias("amount"), first("currency").alias("currency"), prov, F.lit("ftm_import").alias("extraction_source"),
    )
    dropped = proxies.where(kind.isNull() & ~is_edge).select("id", "schema", F.lit("no place for this schema").alias("reason"))
    return entities, edges, dropped
