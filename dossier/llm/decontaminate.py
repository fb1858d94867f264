"""Benchmark decontamination with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.bitmap import marked
from dossier.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Word characters are digits, a-z (after lower-casing A-Z) and everything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct opening hashes in one hash set, which is broadcast with the plan (50 MB at most in memory). More of them are
#: dealt into several sets of this size, with a pass over the documents for each.
OPENINGS = 1_000_000
OPENING = 3


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _gram(start: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get("_w", start + k) for k in range(n)])


def _opening(start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get("_w", start + k) for k in range(min(n, OPENING))])


def _among(value: Column, openings: DataFrame) -> Column:
    """Whether value is in the one long column of openings, a hash set in the plan; it goes from Spark to Spark."""
    values = openings.agg(F.collect_set(openings.columns[0]))._jdf.first().getSeq(0)
    return type(value)(value._jc.isInCollection(values))


def _window(n: int, openings: DataFrame):
    """The n words from a position, or null if they overrun the text or open as no window does."""

    def window(_, i):
        inside = (i + n <= F.size("_w")) & _among(_opening(i, n), openings)
        return F.when(inside, F.struct(i.alias("pos"), F.lit(n).alias("n"), _gram(i, n).alias("gram")))

    return window


def _item_windows(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(n, gram, opening, item) of every window; n is the width, or less for a short item."""
    w = items.select(F.col(f"`{item_col}`").cast("string").alias("_item"), words(F.col(f"`{text_col}`")).alias("_w")).where(F.size("_w") > 0)
    long = w.where(F.size("_w") >= width).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_w") - width)))
    parts = [long.select("_item", F.lit(width).alias("_n"), _gram(F.col("_i"), width).alias("_g"), _opening(F.col("_i"), width).alias("_open"))]
    for n in range(1, width):
        short = w.where(F.size("_w") == n)
        parts.append(short.select("_item", F.lit(n).alias("_n"), _gram(F.lit(0), n).alias("_g"), _opening(F.lit(0), n).alias("_open")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def find_contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items (sorted ids), hits (pos, n), contaminated.

    The first words of the items' windows form a hash set that is broadcast; its size is bounded, and
    a benchmark with more windows is dealt into several sets, each with its own pass. A document's
    positions pass the set, and the words of those that pass are compared with the windows' own: a
    join on the words themselves, so hash collisions cannot count. Nothing of a document is shuffled
    but its matches and one row of counts.
    Null and empty texts have no words; items without words have no windows; a null item id is left
    out of items. Repeated rows are judged each on its own, null ids too. Texts of any length are read
    whole. Extra columns are ignored. Empty tables: no documents give no rows, no items no hits.
    """
    windows = materialise(_item_windows(items, width, item_col, item_text_col), "windows")
    lengths = {r[0]: r[1] for r in windows.groupBy("_n").agg(F.countDistinct("_open")).collect()}  # at most width rows
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.monotonically_increasing_id().alias("_row"), words(F.col(f"`{text_col}`")).alias("_w"))
    kind = "array<struct<pos:int,n:int,gram:string>>"
    # The row of counts meets no window (n = 0) and has a word of its own, so these rows don't meet in a task.
    counts = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("n"), F.col("_row").cast("string").alias("gram")))
    sets = {n: -(-k // OPENINGS) for n, k in lengths.items()}
    spots = None
    for turn in range(max([1, *sets.values()])):
        found = [counts.cast(kind)] if turn == 0 else []
        for n in sorted(k for k, many in sets.items() if turn < many):
            own = windows.where((F.col("_n") == n) & (F.pmod("_open", F.lit(sets[n])) == turn)).select("_open").distinct()
            found.append(F.filter(F.transform("_w", _window(n, own)), lambda x: x.isNotNull()))
        part = base.select("_id", "_row", F.size("_w").cast("long").alias("_words"), F.inline(F.concat(*found)))
        spots = part if spots is None else spots.union(part)
    keys = windows.select("_item", F.col("_n").alias("_wn"), F.col("_g").alias("_wg"))
    matched = spots.join(keys, (F.col("gram") == F.col("_wg")) & (F.col("n") == F.col("_wn")), "left").where("pos < 0 or _wn is not null")
    hit = F.when(F.col("pos") >= 0, F.struct("pos", "n"))
    grouped = matched.groupBy("_row").agg(
        F.first("_id").alias("_id"), F.max("_words").alias("n_words"), F.sort_array(F.collect_set(hit)).alias("hits"), F.sort_array(F.collect_set("_item")).alias("items")
    )

    def cover(acc, x):
        end = x["pos"] + x["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["pos"]))).alias("n"))

    covered = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover)["n"].cast("long")
    return grouped.select(
        F.col("_id").alias(id_col), "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits", (F.size("hits") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", width: int = 10, text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or (remove='spans') without the words that were hit.

    What is hit depends on the text alone, so findings go back to documents by two hashes of it, 96
    bits in all. A bitmap of the hashes parts the documents that surely stay as they are; only the
    others are shuffled. A removed word takes the separators after it along. Null texts stay as they
    are, repeated rows are judged each. Columns are those of docs, extra ones included.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    keys = [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]
    found = find_contamination(plain.select(F.struct(*keys).alias("key"), F.col(text).alias("text")), items, width, "key")
    found = found.where("contaminated").groupBy("key").agg(F.first("hits").alias("hits"))
    found = materialise(found.select(F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"), "hits"), "contaminated")
    keyed = marked(plain.select("*", *keys), F.col("k1"), found.select("k1"), "doubt")
    sure, doubt = keyed.where("not doubt").select(*plain.columns), keyed.where("doubt")
    if remove == "documents":
        kept = doubt.join(found.select("k1", "k2"), ["k1", "k2"], "left_anti").select(*plain.columns)
    else:
        kept = doubt.join(found, ["k1", "k2"], "left")
        separator = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
        pieces = F.split(F.col(text), f"(?<={separator})(?=[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])")
        lead = F.col(text).rlike("^" + separator).cast("int")
        left = F.filter(pieces, lambda _, i: ~F.exists("hits", lambda x: (i - lead >= x["pos"]) & (i - lead < x["pos"] + x["n"])))
        kept = kept.withColumn(text, F.when(F.col("hits").isNotNull(), F.array_join(left, "")).otherwise(F.col(text)))
    return sure.union(kept.select(*plain.columns)).toDF(*names)
