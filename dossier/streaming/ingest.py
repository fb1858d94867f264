"""Incremental ingest: new files of a folder become documents and chunks, each document replacing its former self."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.extract import chunks
from dossier.operators.store import upsert

SCHEMA = "path string, text string, ingested_at timestamp"


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """A query that runs once over what is new: documents (JSON lines of SCHEMA) to target/document and target/chunk.

    A batch that is run again gives the same tables, since rows are replaced by id.
    """
    incoming = spark.readStream.schema(SCHEMA).json(folder)
    return incoming.writeStream.foreachBatch(lambda df, n: replace(df, n, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace(batch: DataFrame, number: int, target: str) -> None:
    spark = batch.sparkSession
    new = batch.groupBy("path").agg(F.max_by("text", "ingested_at").alias("text"), F.max("ingested_at").alias("ingested_at")).withColumn("id", F.substring(F.sha2("path", 256), 1, 16))
    pieces = chunks(new)
    for name, rows, key in (("document", new, "id"), ("chunk", pieces, "doc_id")):
        now = f"{target}/{name}/v={number}"
        old = [int(r) for r in _versions(spark, f"{target}/{name}") if int(r) < number]
        if old:
            was = spark.read.parquet(f"{target}/{name}/v={max(old)}")
            rows = upsert(was, rows, "id") if key == "id" else was.join(new.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(now)


def _versions(spark: SparkSession, folder: str) -> list[str]:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return [s.getPath().getName()[2:] for s in fs.listStatus(p) if s.getPath().getName().startswith("v=")] if fs.exists(p) else []


def current(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{name}/v={max(map(int, _versions(spark, f'{target}/{name}')))}")
