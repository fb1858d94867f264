"""Grounding: which entities and edges the chunks support; gates that edges must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as X

#: Labels that may be broadcast to the chunks (about 200 bytes each); beyond it the join is shuffled.
BROADCAST_LABELS = 500_000
#: Different first words of labels that may travel in the plan as a set; beyond it the join alone sifts.
FIRST_WORDS = 20_000
#: Runs of a label that it is looked up by, at most.
KEY_RUNS = 16


def mentions(entity: DataFrame, chunk: DataFrame, id_col: str = "id", label_col: str = "label", chunk_col: str = "id", body_col: str = "body") -> DataFrame:
    """(entity, chunk): the label stands in the chunk as whole words.

    Not every label is tried on every chunk: a label's runs of word characters, the first KEY_RUNS of
    them, are looked up among the chunk's sequences of as many runs, an equi-join, and only then is the
    pattern tried. A label without such a run, or shorter than two characters, matches nothing.
    """
    runs = lambda c: F.filter(F.split(c, r"(?U)\W+"), lambda w: w != "")
    labels = entity.select(F.col(id_col).alias("entity"), X.norm(F.col(label_col)).alias("_label")).where("length(_label) >= 2")
    labels = labels.withColumn("_runs", F.slice(runs("_label"), 1, KEY_RUNS)).where("size(_runs) > 0")
    labels = labels.select("entity", "_label", F.get("_runs", F.lit(0)).alias("_word"), F.size("_runs").alias("_n"), F.xxhash64("_runs").alias("_key"))
    body = chunk.select(F.col(chunk_col).alias("chunk"), X.norm(F.col(body_col)).alias("_body"))
    body = body.select("chunk", "_body", runs("_body").alias("_runs"))
    first = [r[0] for r in labels.select("_word").distinct().limit(FIRST_WORDS + 1).collect()]
    sizes = sorted(r[0] for r in labels.select("_n").distinct().collect())  # KEY_RUNS at most
    places = F.when(F.size("_runs") > 0, F.sequence(F.lit(1), F.size("_runs"))).otherwise(F.array().cast("array<int>"))
    if len(first) <= FIRST_WORDS:
        # Sequences are made where a label may begin only.
        places = F.filter(places, lambda i: F.get("_runs", i - 1).isin(first)) if first else F.array().cast("array<int>")
    keys = F.transform(places, lambda i: F.array_compact(F.array(*[F.when(i + (n - 1) <= F.size("_runs"), F.xxhash64(F.slice("_runs", i, n))) for n in sizes] or [F.lit(None).cast("long")])))
    words = body.select("chunk", "_body", F.explode(F.array_distinct(F.flatten(keys))).alias("_key"))
    few = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    labels = labels.select("entity", "_label", "_key")
    return words.join(F.broadcast(labels) if few else labels, "_key").where(X.whole_word(F.col("_label"), F.col("_body"))).select("entity", "chunk").distinct()


def ground_entities(entity: DataFrame, found: DataFrame) -> DataFrame:
    return entity.join(found.select(F.col("entity").alias("id")), "id", "left_semi")


def ground_edges(edge: DataFrame, found: DataFrame, least: int = 1) -> DataFrame:
    """Edges whose ends share at least so many chunks."""
    a, b = found.select(F.col("entity").alias("source_id"), "chunk"), found.select(F.col("entity").alias("target_id"), "chunk")
    pairs = edge.select("source_id", "target_id").distinct()
    shared = pairs.join(a, "source_id").join(b, ["target_id", "chunk"]).groupBy("source_id", "target_id").agg(F.count_distinct("chunk").alias("n")).where(F.col("n") >= least)
    return edge.join(shared.drop("n"), ["source_id", "target_id"], "left_semi")


def rescue_entities(entity: DataFrame, grounded: DataFrame, sources: tuple[str, ...] = ("structured",)) -> DataFrame:
    """Ungrounded structured entities whose (type, name key) a grounded entity has; blank keys never match."""
    keys = grounded.select("entity_type", X.norm_name(F.col("label")).alias("_key")).where("_key is not null").distinct()
    loose = entity.join(grounded.select("id"), "id", "left_anti").where(F.col("extraction_source").isin(*sources))
    return loose.withColumn("_key", X.norm_name(F.col("label"))).join(keys, ["entity_type", "_key"], "left_semi").select(*entity.columns)


def rescue_edges(edge: DataFrame, kept: DataFrame, sources: tuple[str, ...] = ("structured",)) -> DataFrame:
    """Structured edges both of whose ends are kept."""
    ids = kept.select("id")
    own = edge.where(F.col("extraction_source").isin(*sources))
    return own.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edge.columns)


def provenance_gate(edge: DataFrame, document: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected): source_url is a document's url or path, or provenance is a document's id; blanks match nothing.

    Two semi-joins on equal keys instead of one on a disjunction. Edges need an ord that is theirs alone.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    places = [c for c in ("url", "path", "id") if c in document.columns]
    locators = document.select(F.explode(F.array(*[blank(F.col(c).cast("string")) for c in places])).alias("_u")).where("_u is not null").distinct()
    ids = document.select(blank(F.col("id").cast("string")).alias("_u")).where("_u is not null").distinct()
    by_url = edge.withColumn("_u", blank(F.col("source_url"))).join(locators, "_u", "left_semi").select("ord")
    by_id = edge.withColumn("_u", blank(F.col("provenance"))).join(ids, "_u", "left_semi").select("ord")
    good = by_url.union(by_id).distinct()
    return edge.join(good, "ord", "left_semi").select(*edge.columns), edge.join(good, "ord", "left_anti").select(*edge.columns)


def grade_gate(edge: DataFrame, entity: DataFrame, domain_range: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legal, violating) by domain_range: edge_type, src, tgt, where * is any type. The table is the vocabulary's, so it is broadcast."""
    kinds = entity.select("id", "entity_type")
    typed = edge.join(kinds.select(F.col("id").alias("source_id"), F.col("entity_type").alias("_st")), "source_id").join(kinds.select(F.col("id").alias("target_id"), F.col("entity_type").alias("_tt")), "target_id")
    rule = F.broadcast(domain_range.select(F.col("edge_type").alias("_e"), "src", "tgt"))
    fits = (F.col("edge_type") == F.col("_e")) & ((F.col("src") == "*") | (F.col("src") == F.col("_st"))) & ((F.col("tgt") == "*") | (F.col("tgt") == F.col("_tt")))
    return typed.join(rule, fits, "left_semi").select(*edge.columns), typed.join(rule, fits, "left_anti").select(*edge.columns)
