"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.bitmap import marked
from dossier.session import discard, materialise


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, digest: bool = True) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept and, if digest, text_sha256.

    Levels: (1) texts whose byte length nobody shares are unique; (2) of the rest, those whose hash of
    length and prefix nobody shares are unique; (3) the full SHA-256 is taken of survivors and decides.
    Each level counts narrow keys, partially summed before the shuffle, so a group of copies of any
    size costs a row per task. Survivors are told by a bitmap of the keys that the level before found
    shared: what it lets through by chance is judged by the next level like any other, and the last
    compares full hashes. So no text is shuffled, and nothing that is broadcast grows with the data.

    Of equal texts the row with the largest id stays; of repeated rows with the same id one stays.
    Null texts count as empty; null ids lose to any other. Texts of any length are hashed whole. Extra
    columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("_len"))
    shared = lambda df, k: materialise(df.groupBy(k).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(k), "exact-shared")
    # Level 1: lengths. Level 2: prefixes of those whose length is shared.
    lengths = shared(base.select("_len"), "_len")
    some = marked(base, F.col("_len"), lengths, "_again").withColumn("_prefix", F.xxhash64("_len", F.substring("_text", 1, prefix_chars)))
    prefixes = shared(some.where("_again").select("_prefix"), "_prefix")
    some = marked(some, F.col("_prefix"), prefixes, "_more")
    # Level 3. Rows known to be unique have no full hash here; the digest is the query's own column.
    full, wanted = F.sha2(F.col("_text"), 256), F.col("_again") & F.col("_more")
    rows = some.select("_id", F.monotonically_increasing_id().alias("_row"), F.when(wanted, full).alias("_full"), *([full.alias("text_sha256")] if digest else []))
    rows = materialise(rows, "exact-rows")
    discard(lengths, prefixes)
    # A row known to be unique carries a key of its own, so nulls don't meet in a task.
    key = F.coalesce(F.col("_full"), F.concat(F.lit("row "), F.col("_row").cast("string"))).alias("_key")
    groups = (
        rows.where(F.col("_full").isNotNull())
        .groupBy(F.col("_full").alias("_key"))
        .agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
    )
    # Written first, so that the join deals its sides anew and a hot key can be divided among tasks.
    groups = materialise(groups, "exact-groups")
    out = rows.withColumn("_key", key).join(groups, "_key", "left")
    lone = F.col("_size").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(lone, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1)).cast("long").alias("group_size"),
        (lone | (F.col("_keep._row") == F.col("_row"))).alias("kept"),
        *(["text_sha256"] if digest else []),
    )
