"""Extraction: chunks, patterns, providers of names and relations, candidate pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators.merge import first_seen
from dossier.sources.ontology import canonical_type

WINDOW = 240
#: How sure each way of extraction is.
CONFIDENCE = {"date": 0.9, "money": 0.85, "email": 0.9, "name": 0.7, "pair": 0.65, "model": 0.6}
ENTITY = "doc_id string, label string, entity_type string, confidence double, provenance string, ord long"


def chunks(document: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, doc_id, chunk_index, body) of documents (id, path, text)."""
    w = document.select(F.col("id").alias("doc_id"), "path", F.posexplode(X.windows(F.col("text"), size, overlap)).alias("chunk_index", "body"))
    return w.select(X.uuid5(F.concat("path", F.lit(":"), F.col("chunk_index").cast("string"))).alias("id"), "doc_id", "chunk_index", "body")


def patterns(document: DataFrame, email: bool = False) -> DataFrame:
    """Dates as events and sums of money as transactions; addresses of e-mail if asked. First of a label in a document."""
    kinds = [(X.DATE, "event", "date", 0), (X.MONEY, "transaction", "money", 1)] + ([(X.EMAIL, "contact", "email", 2)] if email else [])
    found = F.concat(*[_all(*k) for k in kinds])
    rows = document.select(F.col("id").alias("doc_id"), F.explode(found).alias("e")).select("doc_id", "e.*")
    return first_seen(rows, ["doc_id", "entity_type", "label"]).withColumn("provenance", F.lit("deterministic")).select("doc_id", "label", "entity_type", "confidence", "provenance", "ord")


def _all(pattern: str, kind: str, sure: str, n: int):
    """All matches of a pattern as records; their order is the pattern's, then the text's."""

    def record(m, i):
        return F.struct(m.alias("label"), F.lit(kind).alias("entity_type"), F.lit(CONFIDENCE[sure]).alias("confidence"), (i.cast("long") + n * 1_000_000).alias("ord"))

    return F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})")), record)


def provided(document: DataFrame, provider: Callable[[str], list[tuple[str, str]]], sure: str = "name", source: str = "nlp") -> DataFrame:
    """Entities by a provider text -> [(label, type)] over whole texts; labels of two characters at least, each once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text in zip(f["id"], f["text"], strict=True):
                seen = set()
                for label, kind in provider(text or ""):
                    label = label.strip()
                    if len(label) >= 2 and label.lower() not in seen:
                        seen.add(label.lower())
                        rows.append((doc, label, kind, CONFIDENCE[sure], source, len(seen)))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "entity_type", "confidence", "provenance", "ord"])

    return document.select("id", "text").mapInPandas(run, ENTITY)


def gazetteer(table: dict[str, str]) -> Callable[[str], list[tuple[str, str]]]:
    """A provider that knows its names: label -> type."""
    import re

    order = sorted(table, key=lambda x: (-len(x), x))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, order)) + r")(?!\w)") if order else None
    return lambda text: [(m, table[m]) for m in pattern.findall(text)] if pattern else []


def relations(chunk: DataFrame, provider: Callable[[str], list[dict]]) -> DataFrame:
    """Edges by a provider body -> [{source, target, type, evidence}]; malformed ones are left out.

    Every chunk is asked for; where the provider fails, the error is a row of its own.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for cid, body in zip(f["id"], f["body"], strict=True):
                try:
                    found = provider(body)
                except Exception as e:  # noqa: BLE001
                    rows.append((cid, None, None, None, None, None, str(e)[:200]))
                    continue
                for x in found:
                    if isinstance(x, dict) and all(str(x.get(k) or "").strip() for k in ("source", "target", "type")):
                        rows.append((cid, x["source"], x["target"], x["type"], str(x.get("evidence") or "")[: X.EVIDENCE_CAP], CONFIDENCE["model"], None))
            yield pd.DataFrame(rows, columns=["chunk_id", "source", "target", "edge_type", "evidence", "confidence", "error"])

    return chunk.select("id", "body").mapInPandas(run, "chunk_id string, source string, target string, edge_type string, evidence string, confidence double, error string")


def with_fallback(remote: Callable, local: Callable) -> Callable:
    """A provider that asks remote and, where that fails, local."""

    def ask(text: str):
        try:
            return remote(text)
        except Exception:  # noqa: BLE001
            return local(text)

    return ask


def records(found: DataFrame, now: int, url: str = "source_url") -> DataFrame:
    """Entity records of (label, entity_type, source_url): the id that label, type and source give, one stamp for created and updated."""
    kind = canonical_type(F.col("entity_type"))
    base = found.withColumns({"id": X.entity_id(F.col("label"), kind, F.col(url)), "entity_type": kind, "created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long")})
    return base.withColumn("confidence", F.coalesce("confidence", F.lit(0.5)) if "confidence" in found.columns else F.lit(0.5))


def pair_candidates(entity: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ordered pairs of different labels of a document at most window characters apart; entity: doc_id, label, pos.

    Positions meet by stretches of window characters: a pair lies in one stretch or two that touch, so
    the join is on equal keys and a long document gives no pairs of all its entities.
    """
    a = entity.select("doc_id", F.col("label").alias("a"), F.col("pos").alias("pa"), F.explode(F.array(*[F.floor(F.col("pos") / window) + d for d in (-1, 0, 1)])).alias("k"))
    b = entity.select("doc_id", F.col("label").alias("b"), F.col("pos").alias("pb"), F.floor(F.col("pos") / window).alias("k"))
    near = a.join(b, ["doc_id", "k"]).where((F.col("a") != F.col("b")) & (F.abs(F.col("pa") - F.col("pb")) <= window))
    return near.groupBy("doc_id", "a", "b").agg(F.min(F.abs(F.col("pa") - F.col("pb"))).alias("distance"))


def find_entity(wanted: DataFrame, entity: DataFrame) -> DataFrame:
    """(doc_id, label, id): the entity of that label in the document, else the first whose label holds it or is held by it; blank finds nothing."""
    w = wanted.where("trim(label) <> ''").select("doc_id", "label", F.lower(F.trim("label")).alias("_w")).distinct()
    e = entity.where("trim(label) <> ''").select("doc_id", F.col("id"), F.col("ord"), F.lower(F.trim("label")).alias("_e"))
    hit = w.join(e, "doc_id").where(F.col("_e").contains(F.col("_w")) | F.col("_w").contains(F.col("_e")))
    return hit.groupBy("doc_id", "label").agg(F.min_by("id", F.struct((F.col("_e") != F.col("_w")).alias("x"), "ord")).alias("id"))
