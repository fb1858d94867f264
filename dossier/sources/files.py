"""Readers of folders: texts, notes, tables, JSON lines."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = (".txt", ".md", ".html", ".htm")
TABLES = {".csv": ",", ".tsv": "\t"}
FRONTMATTER = r"(?s)\A---\r?\n.*?\r?\n---\r?\n"


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (*TEXT, *TABLES)) -> DataFrame:
    """(path, length, modified) of supported files at any depth; names and folders that begin with . or _ are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    inside = F.regexp_replace("path", "^.*?" + PurePosixPath(folder.split("://")[-1]).as_posix().rstrip("/").replace(".", r"\."), "")
    hidden = inside.rlike(r"/[._]")
    return files.where(~hidden & F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")).orderBy("path")


def strip_frontmatter(text: Column) -> Column:
    """A text without the YAML block it begins with."""
    return F.regexp_replace(text, FRONTMATTER, "")


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, common entities replaced, white space collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder: id (16 hex digits of the path's SHA-256), path, title, text. Readable kinds only."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    page = F.lower("path").rlike(r"\.html?$")
    known = raw.where(F.lower("path").rlike(r"\.(txt|md|html?)$") & ~F.col("path").rlike(r"/[._][^/]*$"))
    text = F.when(page, strip_html(F.col("text"))).otherwise(strip_frontmatter(F.col("text")))
    return known.select(F.substring(F.sha2("path", 256), 1, 16).alias("id"), "path", F.element_at(F.split("path", "/"), -1).alias("title"), text.alias("text"))


def numbered(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in the order of the scan: each partition's rows are counted first, one number for each partition."""
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part, inside = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    total, before = 0, []
    for p, n in counts:
        before.append((p, total))
        total += n
    base = df.sparkSession.createDataFrame(before, "_p long, _before long")
    return marked.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn(name, F.col("_before") + inside + 1).drop("_m", "_p", "_before")


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV file with a header, all columns text, quoting honoured; row_no counts from 1 in file order."""
    sep = TABLES[PurePosixPath(path).suffix.lower()]
    return numbered(spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; unknown fields are passed over."""
    return spark.read.schema(schema).json(path)


def route(paths: list[str]) -> dict[str, str]:
    """Which table files have their mapping `<stem>.map.yaml` beside them."""
    have = set(paths)
    out = {}
    for p in paths:
        q = PurePosixPath(p)
        spec = str(q.with_name(q.stem + ".map.yaml"))
        if q.suffix.lower() in TABLES and spec in have:
            out[p] = spec
    return out


MANIFEST = (
    "schema string, artifact_id string, kind string, capture_group string, source_url string, final_url string, redirect_chain array<string>, http_status int, "
    "local_path string, sha256 string, bytes long, captured_at string, capture_method string, tool_version string, collector string, parent_sha256 string, notes string, title string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MANIFEST)


def pending_sources(sources: DataFrame, manifest: DataFrame, force: bool = False, only: str | None = None) -> DataFrame:
    """Declared sources without an artefact of their id, or of their id and a suffix."""
    wanted = sources if only is None else sources.where(F.col("id") == only)
    if force:
        return wanted
    # An artefact's id and each of its prefixes before a hyphen are looked up, an equi-join.
    parts = F.split("artifact_id", "-")
    stems = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    done = manifest.select(F.explode(stems).alias("id")).distinct()
    return wanted.join(done, "id", "left_anti")


def read_findings(entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, mentions) of entities with a provenance list of artefacts."""
    each = entity.select(F.col("id").alias("entity_id"), F.explode("provenance").alias("doc_id")).where("trim(doc_id) <> ''").distinct()
    return each.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("path")).distinct(), each
