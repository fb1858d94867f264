"""Evidence: ledgers, manifests, payloads of captures, and the gates over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.session import materialise, partitions

TOKEN = r"[a-z0-9][a-z0-9.]*(?:-[a-z0-9.]+)+"
COLUMNS = ("ledger_id", "finding", "origin", "status", "source", "artifact")


def ledger(report: DataFrame) -> DataFrame:
    """Rows of the first table whose header names finding, origin and artifact; report: doc, text. Rows of under six cells are passed over."""
    lines = report.select("doc", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw")).withColumn("line", F.trim("raw"))
    bar = F.col("line").rlike(r"^\|.*\|$")
    low = F.lower("line")
    head = bar & low.contains("finding") & low.contains("origin") & low.contains("artifact")
    first = lines.groupBy("doc").agg(F.min(F.when(head, F.col("n"))).alias("head"))
    after = lines.join(first, "doc").where(F.col("n") > F.col("head"))
    end = after.groupBy("doc").agg(F.min(F.when(~bar, F.col("n"))).alias("end"))
    rows = after.join(end, "doc").where((F.col("end").isNull() | (F.col("n") < F.col("end"))) & ~F.col("line").rlike(r"^[|\-: ]*$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("doc", "n", cells.alias("c")).where("size(c) >= 6").select("doc", "n", *[F.col("c")[i].alias(k) for i, k in enumerate(COLUMNS)])


def tokens(cell: Column) -> Column:
    return F.regexp_extract_all(cell, F.lit(f"({TOKEN})"))


def link(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(ledger_id, token, artifact_id) of cited tokens that name an artefact, or else a capture group and all its files."""
    cited = rows.select("ledger_id", F.explode(F.array_distinct(tokens(F.col("artifact")))).alias("token"))
    by_id = cited.join(manifest.select(F.col("artifact_id").alias("token"), "artifact_id"), "token")
    rest = cited.join(by_id.select("ledger_id", "token"), ["ledger_id", "token"], "left_anti")
    by_group = rest.join(manifest.where("capture_group <> ''").select(F.col("capture_group").alias("token"), "artifact_id"), "token")
    return by_id.select("ledger_id", "token", "artifact_id").union(by_group.select("ledger_id", "token", "artifact_id"))


def linkage_gate(rows: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """A problem for each cited artefact that is missing or changed, and each row without one; files: local_path, sha256."""
    links = link(rows, manifest)
    seen = links.join(manifest.select("artifact_id", "local_path", F.col("sha256").alias("said")), "artifact_id").join(files.select("local_path", "sha256"), "local_path", "left")
    bad = seen.select("ledger_id", "artifact_id", F.when(F.col("sha256").isNull(), "missing file").when(F.col("sha256") != F.col("said"), "hash differs").alias("problem")).where("problem is not null")
    pending = F.lower("artifact").rlike(r"\b(pending|uncaptured|draft-only|incoming|none)\b")
    none = rows.where(~pending).join(links.select("ledger_id"), "ledger_id", "left_anti").select("ledger_id", F.lit(None).cast("string").alias("artifact_id"), F.lit("no artefact").alias("problem"))
    return bad.union(none)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(X.status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def ledger_gate(rows: DataFrame) -> DataFrame:
    """Rows whose status is in no closed set, or says unverified."""
    return rows.where((X.status(F.col("status")) == "") | F.upper("status").contains("UNVERIFIED")).select("ledger_id", "status")


def minimise_gate(files: DataFrame, denied: list[str]) -> DataFrame:
    """(path, token) of denied tokens in public files; an empty list is an error, so the gate fails closed."""
    wanted = sorted({d.strip().lower() for d in denied if d.strip()})
    if not wanted:
        raise ValueError("the denylist is empty")
    found = F.filter(F.array(*[F.lit(x) for x in wanted]), lambda t: F.contains(F.lower("text"), t))
    return files.select("path", F.explode(found).alias("token"))


def manifest_rows(files: DataFrame, kind: str, method: str, collector: str, now: str) -> DataFrame:
    """Manifest rows of files (path, content): hash, size, time, collector."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(X.slug(name).alias("artifact_id"), F.lit(kind).alias("kind"), F.col("path").alias("local_path"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"), F.lit(now).alias("captured_at"), F.lit(method).alias("capture_method"), F.lit(collector).alias("collector"))


def breach_count(body: Column) -> Column:
    """Entries of a breach search, else its total, else 0."""
    v = F.try_parse_json(body)
    entries = F.try_variant_get(v, "$.entries", "array<variant>")
    return F.when(entries.isNotNull(), F.size(entries)).otherwise(F.coalesce(F.try_variant_get(v, "$.total", "int"), F.lit(0)))


def crt_names(body: Column) -> Column:
    """Names on certificates: lines split, wildcards dropped, sorted."""
    rows = F.from_json(body, "array<struct<name_value:string>>")
    names = F.flatten(F.transform(rows, lambda r: F.split(F.lower(r["name_value"]), "\n")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.startswith("*."))))


def cdx_span(body: Column) -> Column:
    """(first, last, n) of archived captures, the header row aside."""
    rows = F.slice(F.from_json(body, "array<array<string>>"), F.lit(2), F.lit(1_000_000))
    stamps = F.transform(rows, lambda r: F.get(r, F.lit(1)))
    return F.struct(F.array_min(stamps).alias("first"), F.array_max(stamps).alias("last"), F.size(stamps).alias("n"))


def siblings(domain: DataFrame) -> DataFrame:
    """Pairs of domains with a name server, an address or a registrar in common; domain: name, ns, a, registrar.

    Shared values are the join keys; a value held by very many domains makes as many pairs as it asks for.
    """
    keys = F.concat(F.transform("ns", lambda x: F.concat(F.lit("ns "), F.lower(x))), F.transform("a", lambda x: F.concat(F.lit("a "), x)), F.when(F.coalesce("registrar", F.lit("")) != "", F.array(F.concat(F.lit("registrar "), F.lower("registrar")))).otherwise(F.array().cast("array<string>")))
    each = domain.select("name", F.explode(F.array_distinct(keys)).alias("k"))
    a, b = each.select(F.col("name").alias("x"), "k"), each.select(F.col("name").alias("y"), "k")
    return a.join(b, "k").where("x < y").groupBy("x", "y").agg(F.array_sort(F.collect_set("k")).alias("shared"))


def claims(document: DataFrame, include: str, exclude: str) -> DataFrame:
    """(id, line_no, line) of lines that a pattern finds and another doesn't excuse."""
    lines = document.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(include) & ~F.col("line").rlike(exclude)).select("id", (F.col("line_no") + 1).alias("line_no"), "line")


def selector(raw: Column, fields: tuple[str, ...] = ("email", "username", "ip_address", "name", "address", "phone", "domain")) -> Column:
    """(field, value) of `field:value` if the field is known, else null."""
    parts = F.split(raw, ":", 2)
    field, value = F.lower(F.trim(parts[0])), F.trim(F.get(parts, F.lit(1)))
    return F.when(field.isin(*fields) & (value != ""), F.struct(field.alias("field"), value.alias("value")))


def numbered(frame: DataFrame, *order: str) -> DataFrame:
    """frame with ord, counting from 1 in an order: range partitions are numbered each, after the rows of those before."""
    spark = frame.sparkSession
    dealt = materialise(frame.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part, n, before = F.shiftright("_m", 33), 0, []
    for p, c in sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()):
        before.append((p, n))
        n += c
    first = spark.createDataFrame(before, "_p long, _first long")  # one row for each partition
    return dealt.withColumn("_p", part).join(F.broadcast(first), "_p").withColumn("ord", F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_p", "_first")
