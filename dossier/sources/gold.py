"""Gold notes: entities and edges that a note's front matter declares."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY = "note string, ord long, id string, entity_type string, label string"
EDGE = "note string, ord long, source_id string, edge_type string, target_id string, evidence string"


def _front(text: str) -> dict:
    if not (text or "").startswith("---"):
        return {}
    parts = text.split("\n---", 1)
    try:
        found = yaml.safe_load(parts[0][3:])
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


def _rows(text: str, key: str) -> list[dict]:
    return [x for x in _front(text).get(key) or [] if isinstance(x, dict)]


def read_gold(note: DataFrame, types: dict[str, str] | None = None, edges: dict[str, str] | None = None, flip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of notes (path, text). Types are mapped, edges in flip turned round; the first definition of an
    id wins, and an end that nobody defines gets a placeholder. source_url is the note's path, so gates can trace it."""
    types, edges = types or {}, edges or {}

    def entities(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(p, i, str(e["id"]), types.get(str(e.get("type", "")).lower(), str(e.get("type", "")).lower()), str(e.get("canonical") or e["id"])) for p, t in zip(f["path"], f["text"], strict=True) for i, e in enumerate(_rows(t, "entities")) if e.get("id")]
            yield pd.DataFrame(out, columns=["note", "ord", "id", "entity_type", "label"])

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, t in zip(f["path"], f["text"], strict=True):
                for i, e in enumerate(_rows(t, "edges")):
                    if e.get("from") and e.get("to") and e.get("type"):
                        raw = str(e["type"]).upper()
                        a, b = (str(e["to"]), str(e["from"])) if raw in flip else (str(e["from"]), str(e["to"]))
                        out.append((p, i, a, edges.get(raw, raw), b, str(e.get("evidence") or "")[:480]))
            yield pd.DataFrame(out, columns=["note", "ord", "source_id", "edge_type", "target_id", "evidence"])

    defined = note.select("path", "text").mapInPandas(entities, ENTITY).groupBy("id").agg(*[F.min_by(c, F.struct("note", "ord")).alias(c) for c in ("entity_type", "label", "note")])
    edge = note.select("path", "text").mapInPandas(links, EDGE)
    ends = edge.select(F.col("source_id").alias("id"), "note").union(edge.select("target_id", "note")).groupBy("id").agg(F.min("note").alias("note"))
    missing = ends.join(defined.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("entity_type"), F.col("id").alias("label"), "note")
    return defined.unionByName(missing).withColumnRenamed("note", "source_url"), edge.withColumnRenamed("note", "source_url")
