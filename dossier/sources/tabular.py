"""Tables with a mapping: each row becomes entities, edges and a chunk; what doesn't fit is a ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.sources.ontology import Vocabulary, canonical_type

ATTRIBUTES = ("reg_id", "address", "jurisdiction")


class SpecError(ValueError):
    """A mapping that can't be used, found before any job runs."""


@dataclass
class EntityMap:
    column: str
    type: str | None = None
    type_column: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class EdgeMap:
    source: str
    target: str
    type: str
    share_pct: str | None = None
    amount: str | None = None
    currency: str | None = None
    date: str | None = None


@dataclass
class Spec:
    entities: list[EntityMap]
    edges: list[EdgeMap]

    @classmethod
    def load(cls, text: str, vocabulary: Vocabulary | None = None) -> Spec:
        vocabulary = vocabulary or Vocabulary.shipped()
        raw = yaml.safe_load(text) or {}
        try:
            spec = cls([EntityMap(**e) for e in raw.get("entities") or []], [EdgeMap(**e) for e in raw.get("edges") or []])
        except TypeError as e:
            raise SpecError(str(e)) from e
        if not spec.entities:
            raise SpecError("a mapping needs entities")
        known = {e.column: e for e in spec.entities}
        for e in spec.entities:
            if (e.type is None) == (e.type_column is None):
                raise SpecError(f"{e.column}: give type or type_column, one of them")
            if e.type is not None and e.type not in vocabulary.types:
                raise SpecError(f"{e.column}: unknown type {e.type}")
            if odd := set(e.attributes) - set(ATTRIBUTES):
                raise SpecError(f"{e.column}: unknown attributes {sorted(odd)}")
        for e in spec.edges:
            if e.source not in known or e.target not in known:
                raise SpecError(f"{e.type}: its ends must be entity columns")
            if e.type not in {x[0] for x in vocabulary.edges}:
                raise SpecError(f"unknown edge type {e.type}")
            if e.amount and not e.currency:
                raise SpecError(f"{e.type}: an amount needs a currency")
            a, b = known[e.source].type, known[e.target].type
            if a and b and not vocabulary.legal(e.type, a, b):
                raise SpecError(f"{e.type}: not between {a} and {b}")
        return spec


def ingest(table: DataFrame, spec: Spec, url: str, vocabulary: Vocabulary | None = None) -> dict[str, DataFrame]:
    """entities, edges, chunks and skipped of a table with row_no; typed values ride along from end to end.

    Every entity map is a projection of the same scan; the vocabulary is broadcast.
    """
    vocabulary = vocabulary or Vocabulary.shipped()
    spark = table.sparkSession
    src = F.lit(url)
    kinds = {e.column: F.lit(e.type) if e.type else canonical_type(F.col(f"`{e.type_column}`")) for e in spec.entities}
    label = lambda c: F.trim(F.col(f"`{c}`"))
    ident = lambda c: X.entity_id(label(c), kinds[c], src)
    good = lambda c: kinds[c].isin(*vocabulary.types)
    parts, bad = [], []
    for i, e in enumerate(spec.entities):
        rows = table.where(label(e.column) != "")
        extra = [F.col(f"`{e.attributes[a]}`").alias(a) if a in e.attributes else F.lit(None).cast("string").alias(a) for a in ATTRIBUTES]
        parts.append(rows.where(good(e.column)).select(ident(e.column).alias("id"), kinds[e.column].alias("entity_type"), label(e.column).alias("label"), (F.col("row_no") * 100 + i).alias("ord"), *extra))
        bad.append(rows.where(~F.coalesce(good(e.column), F.lit(False))).select("row_no", F.lit("bad_entity_type").alias("reason"), label(e.column).alias("detail")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    entities = every.groupBy("id").agg(*[F.min_by(c, "ord").alias(c) for c in ("entity_type", "label", *ATTRIBUTES)], F.min("ord").alias("ord"))
    entities = entities.withColumns({"source_url": src, "confidence": F.lit(1.0), "provenance": F.lit("table"), "extraction_source": F.lit("deterministic")})
    rule = F.broadcast(vocabulary.frame(spark))
    edges = []
    for i, e in enumerate(spec.edges):
        col = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
        rows = table.where((label(e.source) != "") & (label(e.target) != "") & good(e.source) & good(e.target))
        cells = {c: F.col(f"`{c}`") for c in (e.source, e.target, e.share_pct, e.amount, e.currency, e.date) if c}
        typed = rows.select(
            ident(e.source).alias("source_id"), ident(e.target).alias("target_id"), F.lit(e.type).alias("edge_type"), X.to_double(col(e.share_pct)).alias("share_pct"), X.to_double(col(e.amount)).alias("amount"),
            col(e.currency).alias("currency"), X.iso_millis(col(e.date)).alias("valid_at_ms"), F.substring(F.concat(F.lit("row "), F.col("row_no").cast("string"), F.lit(": "), X.row_text(**cells)), 1, 500).alias("evidence"),
            src.alias("source_url"), (F.col("row_no") * 100 + i).alias("ord"), kinds[e.source].alias("_a"), kinds[e.target].alias("_b"), "row_no",
        )
        r = rule.select(F.col("edge_type").alias("_e"), "src", "tgt")
        fits = (F.col("edge_type") == F.col("_e")) & ((F.col("src") == "*") | (F.col("src") == F.col("_a"))) & ((F.col("tgt") == "*") | (F.col("tgt") == F.col("_b")))
        edges.append(typed.join(F.broadcast(r), fits, "left_semi").drop("_a", "_b", "row_no"))
        bad.append(typed.join(F.broadcast(r), fits, "left_anti").select("row_no", F.lit("grade_violation").alias("reason"), F.concat_ws(" ", "_a", "edge_type", "_b").alias("detail")))
    out = {"entities": entities, "skipped": bad[0]}
    for b in bad[1:]:
        out["skipped"] = out["skipped"].union(b)
    if edges:
        out["edges"] = edges[0]
        for x in edges[1:]:
            out["edges"] = out["edges"].unionByName(x)
    cells = {c: F.col(f"`{c}`") for c in table.columns if c != "row_no"}
    out["chunks"] = table.select(F.concat(src, F.lit("#row="), F.col("row_no").cast("string")).alias("id"), src.alias("source_url"), F.col("row_no").alias("chunk_index"), X.row_text(**cells).alias("body"))
    return out
