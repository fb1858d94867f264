"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.session import discard, materialise, partitions

SPACE = r"[\x20\x09-\x0D]+"
#: No document and no source is repeated more often than this.
MAX_REPEATS = 3


def rank_weight(rank: Column) -> Column:
    """Sources in code point order, null last, weigh 1, 2, 3, repeating."""
    return 1 + rank % 3


def ramp(rank: Column, n: int) -> tuple[Column, Column]:
    """A linear schedule (weight at the start, at the end): early sources fade, late ones grow."""
    lean = 2.0 * rank / (n - 1) - 1.0 if n > 1 else F.lit(0.0)
    return 1.0 - 0.5 * lean, 1.0 + 0.5 * lean


def water_fill(plan: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """plan (_total, _weight among its columns) with _target: shares of sum(_total) by weight, none above cap times its own.

    At level y a target is min(weight * y, cap * total). Each round sums what is not yet at its cap and
    sets the level anew; those at or below it are at their cap. The level only rises, so it settles.
    """
    total = plan.agg(F.sum("_total")).first()[0] or 0
    most, wide = cap * F.col("_total"), "decimal(38,0)"
    at_cap, full = F.lit(False), -1
    while True:
        done, weight, n = plan.agg(F.sum(F.when(at_cap, most)), F.sum(F.when(~at_cap, F.col("_weight"))), F.count(F.when(at_cap, 1))).first()
        left, weight = total - (done or 0), weight or 0
        if n == full or not weight:
            break
        full = n
        # Whole numbers, as this comparison decides whether a source is at its cap.
        at_cap = F.lit(left).cast(wide) * F.col("_weight").cast("decimal(18,0)") >= F.lit(weight).cast(wide) * most.cast("decimal(19,0)")
    share = (F.lit(left) * F.col("_weight")).cast("double") / F.lit(weight or 1).cast("double")
    return plan.withColumn("_target", F.when(at_cap, most.cast("double")).otherwise(share))


def plan_sources(rows: DataFrame, weigh: Callable[[Column], Column], schedule: Callable[[Column, int], tuple[Column, Column]]) -> DataFrame:
    """A row for each source: _t (its name), _total, _target, _repeats, _rest, _w0, _w1.

    _repeats whole passes over the source and _rest words of one more make its integer target. Sources
    are a table however many there are; ranks by code point come from range partitions, of which the
    driver gets one number each, and levels from sums.
    """
    spark = rows.sparkSession
    order = F.col("_t").asc_nulls_last()
    sources = rows.groupBy(F.col("_source").alias("_t")).agg(F.sum("_size").alias("_total"))
    sources = materialise(sources.repartitionByRange(partitions(spark), order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()), "mix-sources")
    part, n, before = F.shiftright("_m", 33), 0, []
    for p, c in sorted((r[0], r[1]) for r in sources.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()):
        before.append((p, n))
        n += c
    ranked = sources.withColumn("_p", part).join(spark.createDataFrame(before, "_p long, _first long"), "_p")
    rank = F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    low, high = schedule(rank, n)
    ranked = materialise(ranked.select("_t", "_total", weigh(rank).cast("long").alias("_weight"), low.alias("_w0"), high.alias("_w1")), "mix-ranks")
    words = F.least(MAX_REPEATS * F.col("_total"), F.floor(F.col("_target") + 0.5)).cast("long")
    filled = water_fill(ranked).withColumn("_words", words)
    some = F.col("_total") > 0
    repeats, rest = (F.when(some, F.expr(f"_words {x} _total")).otherwise(0).cast("long") for x in ("div", "%"))
    out = materialise(filled.select("_t", "_total", "_target", repeats.alias("_repeats"), rest.alias("_rest"), "_w0", "_w1"), "mix-plan")
    discard(sources, ranked)
    return out


def words_of(text: Column) -> Column:
    """Words of a text as an array; null has none. Splitting costs far less than extracting matches."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weigh: Callable[[Column], Column] = rank_weight,
    schedule: Callable[[Column, int], tuple[Column, Column]] = ramp,
    whole: bool = False,
) -> DataFrame:
    """Each row of docs with what the mix takes of it and where.

    Columns: id, mix_source, size (words), source_size, target, taken (words, repeats counted) and
    places, an array of (copy, words, position): one entry for each time the document is read,
    position in [0, 1] being the training time.

    A source's documents stand in an order drawn from a hash of their ids and sizes, so reruns agree;
    the mix passes over that order as often as the target asks and stops inside the document where
    the target ends; if whole, that document is read as a whole or not at all, whichever brings its
    source nearer to the target. The source's weight over time is linear from w0 to w1; its integral
    is the share of its demand met by then, a quadratic whose inverse gives a word's position.
    Running sums over a source come from range partitions of (source, order): per-partition sums are
    added up on the small table of partitions, so a source with a third of all rows is spread. The
    tables of sources and partitions are joined as their sizes ask.
    Null and empty texts have size 0 and are taken 0 times; null is a source of its own. Repeated rows
    are rows, ties in the order are between equal rows. Texts of any length are counted whole. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = F.size(words_of(F.col(f"`{text_col}`"))).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), size.alias("_size"))
    rows = rows.withColumn("_draw", F.md5(F.concat(F.lit("mix "), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    # Running sums: range partitions by (source, draw), their sums, then sums inside each.
    rows = materialise(rows, "mix-rows")
    dealt = rows.repartitionByRange(partitions(spark), F.col("_source").asc_nulls_first(), "_draw", "_id", "_size").withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "mix-dealt")
    discard(rows)
    plan = plan_sources(dealt, weigh, schedule)
    sums = dealt.groupBy("_source", "_part").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    # What is known of a source in a partition: one row for each partition and each source.
    known = materialise(sums.join(plan, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t"), "mix-known")
    discard(plan)
    inner = Window.partitionBy("_part", "_source").orderBy("_draw", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
        .join(known, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
        .withColumn("_start", F.col("_before") + F.col("_in"))
    )
    extra = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_start"))).cast("long")
    if whole:
        extra = F.when(2 * extra >= F.col("_size"), F.col("_size")).otherwise(F.lit(0).cast("long"))
    placed = placed.withColumn("_extra", extra).withColumn("_taken", F.col("_repeats") * F.col("_size") + F.col("_extra"))
    demand = F.col("_repeats") * F.col("_total") + F.col("_rest")
    # Share of the demand met at time p: (w0 p + (w1 - w0) p^2 / 2) / ((w0 + w1) / 2); inverted for p.
    def position(copy):
        share = (copy * F.col("_total") + F.col("_start")) / demand
        a, w0 = (F.col("_w1") - F.col("_w0")) / 2, F.col("_w0")
        c = share * (F.col("_w0") + F.col("_w1")) / 2
        root = (2 * c) / (w0 + F.sqrt(w0 * w0 + 4 * a * c))
        return F.struct(copy.cast("int").alias("copy"), F.when(copy < F.col("_repeats"), F.col("_size")).otherwise(F.col("_extra")).alias("words"), root.alias("position"))

    copies = F.col("_repeats") + F.when(F.col("_extra") > 0, 1).otherwise(0)
    places = F.when((F.col("_taken") > 0) & (demand > 0), F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), position)).otherwise(F.array().cast("array<struct<copy:int,words:long,position:double>>"))
    out = placed.select(
        F.col("_id").alias(id_col), F.col("_source").alias("mix_source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"), places.alias("places"),
    )
    return out


def by_position(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What mix() returns, range-sorted by the position of a document's first reading; what is not read comes last."""
    first = F.get("places", F.lit(0))["position"]
    return mixed.repartitionByRange(partitions(mixed.sparkSession), first.asc_nulls_last(), id_col).sortWithinPartitions(first.asc_nulls_last(), id_col)


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as mix() reads them, in training order: one row for each time a document is read, sorted by position.

    Documents are mixed whole, so every text stays as it is. Rows are told apart by their id and a
    128-bit hash of all their columns; rows equal in these are read as often as they are taken together.
    Columns are those of docs, whatever their names. An empty table gives an empty result.
    """
    spark, names = docs.sparkSession, docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    ident, text, source = (F.col(f"d{names.index(n)}") for n in (id_col, text_col, source_col))
    key = {"m0": ident, "m1": F.xxhash64(*plain.columns), "m2": F.xxhash64(F.lit(1), *plain.columns)}
    keyed = plain.withColumns(key)
    rows = keyed.select(F.struct(*key).alias("row"), text.alias("text"), source.alias("source"))
    taken = mix(rows, "row", "text", "source", whole=True, **options).where(F.size("places") > 0)
    places = taken.groupBy(*[F.col(f"row.{k}").alias(f"{k}b") for k in key]).agg(F.flatten(F.collect_list("places")).alias("places"), F.count(F.lit(1)).alias("rows"))
    places = materialise(places, "mix-places")
    read = keyed.join(places, F.col("m0").eqNullSafe(F.col("m0b")) & (F.col("m1") == F.col("m1b")) & (F.col("m2") == F.col("m2b")))
    if not places.where("rows > 1").isEmpty():
        read = read.where("rows = 1").union(read.where("rows > 1").dropDuplicates(list(key)))
    order = ["place.position", "m0", "m1", "place.copy"]
    read = read.select(*plain.columns, "m0", "m1", F.explode("places").alias("place"))
    return read.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(*plain.columns).toDF(*names)
