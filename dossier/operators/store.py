"""Tables at rest: upserts, deletes, defaults, the staged build of the graph, statistics, migrations."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators.ground import provenance_gate


#: The columns of the tables at rest, in order, and what stands for a missing value.
SCHEMAS = {
    "chunk": "id string, doc_id string, source_uri string, title string, body string, chunk_index int, sensitivity string, embedding array<float>, entity_ids array<string>, created_at long",
    "document": "id string, path string, url string, title string, sensitivity string, sha256 string, created_at long",
    "entity": "id string, entity_type string, label string, description string, confidence double, provenance string, extraction_source string, source_url string, quality_flag string, trust_penalty double, created_at long, updated_at long",
    "edge": "source_id string, target_id string, edge_type string, confidence double, evidence string, provenance string, extraction_source string, source_url string, amount double, currency string, share_pct double, valid_at_ms long, created_at long, expired_at long",
    "mention": "entity_id string, doc_id string, mention_count long",
}
DEFAULTS = {"sensitivity": "public", "confidence": 0.5, "provenance": "unknown", "quality_flag": "unreviewed", "trust_penalty": 0.0, "chunk_index": 0, "mention_count": 1}


def conform(frame: DataFrame, table: str) -> DataFrame:
    """frame with the columns of a table at rest, in its order and types; missing columns and values get the defaults.

    Columns that the table does not know are an error, so a misspelt one is not lost.
    """
    fields = T.StructType.fromDDL(SCHEMAS[table]).fields
    odd = set(frame.columns) - {f.name for f in fields}
    if odd:
        raise ValueError(f"{table} has no columns {sorted(odd)}")

    def value(f: T.StructField) -> Column:
        c = F.col(f.name) if f.name in frame.columns else F.lit(None)
        return (F.coalesce(c.cast(f.dataType), F.lit(DEFAULTS[f.name]).cast(f.dataType)) if f.name in DEFAULTS else c.cast(f.dataType)).alias(f.name)

    return frame.select(*[value(f) for f in fields])


def create_tables(spark: SparkSession, folder: str) -> list[str]:
    """Makes the tables that are not there yet, empty; those that are stay as they are. The names of the new ones."""
    sc, made = spark.sparkContext, []
    for name, ddl in SCHEMAS.items():
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p):
            spark.createDataFrame([], ddl).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new's rows replace old's of the same key; columns are matched by name."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(batches: DataFrame, key: str = "id", batch: str = "batch") -> DataFrame:
    """The row of the last batch for each key."""
    return batches.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(batch)))).where("_n = 1").drop("_n")


def delete_documents(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti").select(*table.columns)


def with_defaults(records: DataFrame) -> DataFrame:
    """Raw records with confidence 0.5, provenance unknown and the source of extraction filled in."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    prov = F.coalesce(blank("provenance"), F.lit("unknown"))
    return records.withColumns({"confidence": F.coalesce("confidence", F.lit(0.5)), "provenance": prov, "extraction_source": F.coalesce(blank("extraction_source"), prov)})


def link_entities(found: DataFrame) -> DataFrame:
    """(chunk, entity_ids): each chunk's entities, different and in order."""
    return found.groupBy("chunk").agg(F.sort_array(F.collect_set("entity")).alias("entity_ids"))


def build(entity: DataFrame, edge: DataFrame, document: DataFrame, mention: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The graph's tables and one row of counts. The first of an id stands; edges pass the provenance gate and need both ends."""
    kept = entity.groupBy("id").agg(*[F.min_by(c, F.struct("created_at", "label")).alias(c) for c in entity.columns if c != "id"])
    good, bad = provenance_gate(edge, document)
    ids = kept.select("id")
    whole = good.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edge.columns)
    tables = {"entity": kept, "edge": whole, "document": document.dropDuplicates(["id"]), "mention": mention}
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    counts = count(kept, "entities").join(count(whole, "edges")).join(count(bad, "edges_rejected")).join(count(tables["document"], "documents")).join(count(mention, "mentions"))
    return tables, counts


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Written beside and moved into place, so readers see the old graph or the new one, never a part."""
    spark = next(iter(tables.values())).sparkSession
    sc = spark.sparkContext
    path = lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(sc._jsc.hadoopConfiguration())
    staged, old = f"{folder}.staged", f"{folder}.old"
    fs.delete(path(staged), True)
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    fs.delete(path(old), True)
    if fs.exists(path(folder)):
        fs.rename(path(folder), path(old))
    fs.rename(path(staged), path(folder))
    fs.delete(path(old), True)


def stats(chunk: DataFrame) -> DataFrame:
    """(sensitivity, total, embedded, unembedded)."""
    has = F.col("embedding").isNotNull()
    return chunk.groupBy("sensitivity").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(has, 1)).alias("embedded"), F.count(F.when(~has, 1)).alias("unembedded"))


def query(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A parameterised read: named markers, never text pasted into SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


def migrate(version: int, target: int, steps: dict[int, Callable[[], None]]) -> int:
    """Runs the step of each version from the stored one up to target; a missing step is an error before any runs."""
    missing = [v for v in range(version, target) if v not in steps]
    if missing:
        raise RuntimeError(f"no migration from version {missing[0]}")
    for v in range(version, target):
        steps[v]()
    return target


def report(counts: dict, gaps: DataFrame, bridges: DataFrame, hubs: DataFrame) -> str:
    """The topology report as JSON, with 20 gaps, 10 bridges and 10 hubs at most."""
    take = lambda df, n: [r.asDict() for r in df.limit(n).collect()]
    return json.dumps({**counts, "gaps": take(gaps, 20), "bridges": take(bridges, 10), "hubs": take(hubs, 10)}, default=str)


def briefing(new: DataFrame, contradictions: DataFrame, gaps: DataFrame, unlinked: DataFrame, most: int = 10) -> str:
    """A day's briefing in Markdown, from frames that are short or cut to most rows."""
    out = ["# Briefing", "", "## New"]
    out += [f"- {r['entity_type']}: {r['cnt']}" for r in new.orderBy(F.desc("cnt"), "entity_type").collect()]
    out += ["", "## Contradictions"] + [f"- {r['claim_a']} / {r['claim_b']}" for r in contradictions.limit(most).collect()]
    out += ["", "## Gaps"] + [f"- {r['severity']}: {r['question']}" for r in gaps.orderBy("cross_edges", "a", "b").limit(most).collect()]
    out += ["", "## Unlinked"] + [f"- {r['label']} ({r['entity_type']})" for r in unlinked.orderBy("id").limit(most).collect()]
    return "\n".join(out) + "\n"


def skeleton_json(edges: DataFrame, entity: DataFrame, total: int) -> str:
    rows = edges.collect()
    ids = sorted({r["u"] for r in rows} | {r["v"] for r in rows})
    spark = entity.sparkSession
    nodes = entity.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "id string")), "id", "left_semi").select("id", "label", "entity_type").orderBy("id").collect()
    return json.dumps({"nodes": [n.asDict() for n in nodes], "edges": [{"source": r["u"], "target": r["v"]} for r in rows], "reduction": round(1 - len(rows) / max(1, total), 4)})
