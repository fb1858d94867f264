"""Entity resolution: tiers of equivalence and greedy matching, as id maps (id, canonical)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as X
from dossier.operators import linkage as L
from dossier.operators.cosines import cosines
from dossier.plans.components import connected_components
from dossier.session import discard, materialise, partitions

FUZZY = 0.92
COSINE = 0.92


def structured(frame: DataFrame, marks: tuple[str, ...] = ("structured",)) -> DataFrame:
    """Rows that a structured source wrote, by its mark and not by what their provenance says."""
    return frame.where(F.col("extraction_source").isin(*marks))


def has_fields(frame: DataFrame, fields: tuple[str, ...] = ("reg_id", "address", "jurisdiction")) -> Column:
    """Whether any of the fields that are there holds more than separators and format characters."""
    out = F.lit(False)
    for c in (c for c in fields if c in frame.columns):
        out = out | F.coalesce(X.strip_unicode(F.col(c)) != "", F.lit(False))
    return out


def name_pairs(entity: DataFrame) -> DataFrame:
    """(a, b) of a type whose labels have the same comparison key; blank keys pair with nothing."""
    keyed = entity.select("id", X.cluster_key(F.col("entity_type"), F.col("label")).alias("k"))
    return block_pairs(keyed, ("k",)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def cluster_tier(clusters: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A tier from any (id, cluster): the first of a cluster, in the entities' order, is what the others join; ids without one stay."""

    def tier(entity: DataFrame) -> DataFrame:
        known = entity.select("id", "ord").join(clusters.select("id", "cluster").distinct(), "id", "left")
        head = known.where("cluster is not null").groupBy("cluster").agg(F.min_by("id", "ord").alias("head"))
        return known.join(head, "cluster", "left").groupBy("id").agg(F.min_by(F.coalesce("head", "id"), F.coalesce("head", "id")).alias("canonical"))

    return tier


#: Scores so far below the threshold that someone has to decide.
ADJUDICATE = 0.05


def adjudicate(pairs: DataFrame, threshold: float, decide: Callable[[DataFrame], DataFrame] | None = None, band: float = ADJUDICATE) -> tuple[DataFrame, DataFrame]:
    """(pairs that match, pairs left for review): at the threshold they match, in the band below it decide(pairs) says which.

    decide returns those of its pairs that are one; without it the whole band is for review. What is
    below the band is neither.
    """
    score = next(c for c in pairs.columns if c not in ("a", "b"))
    pairs = materialise(pairs.where(F.col(score) >= threshold - band), "adjudicate")
    sure = pairs.where(F.col(score) >= threshold)
    doubt = pairs.where((F.col(score) < threshold) & (F.col(score) >= threshold - band))
    if decide is None:
        return sure, doubt
    one = decide(doubt).select("a", "b")
    return sure.union(doubt.join(one, ["a", "b"], "left_semi").select(*pairs.columns)), doubt.join(one, ["a", "b"], "left_anti").select(*pairs.columns)


def create(ids: DataFrame, entity: DataFrame, make: Callable[[Column], Column]) -> DataFrame:
    """ids (id, canonical) with what nothing matched, its own canonical, named anew by make(id)."""
    alone = ids.where("id = canonical").join(ids.where("id <> canonical").select(F.col("canonical").alias("id")), "id", "left_anti").select("id", F.lit(True).alias("_new"))
    return ids.join(alone, "id", "left").select("id", F.when(F.col("_new"), make(F.col("id"))).otherwise(F.col("canonical")).alias("canonical"))


def by_key(entity: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    """All of a type with one key go to the first of them; a null key joins nothing.

    A partially summed minimum, so a key of any size costs a row for each task; then one join.
    """
    keyed = entity.select("id", "entity_type", F.col(order).alias("_o"), key.alias("_k"))
    first = keyed.where("_k is not null").groupBy("entity_type", "_k").agg(F.min_by("id", "_o").alias("canonical"))
    return keyed.join(first, ["entity_type", "_k"], "left").select("id", F.coalesce("canonical", "id").alias("canonical"))


def exact(entity: DataFrame, order: str = "ord") -> DataFrame:
    return by_key(entity, F.nullif(X.norm(F.col("label")), F.lit("")), order)


def by_name(entity: DataFrame, order: str = "ord") -> DataFrame:
    return by_key(entity, X.norm_name(F.col("label")), order)


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel similarity of the words in order: twice the longest common subsequence over both lengths."""

    def one(x: str, y: str) -> float:
        x, y = " ".join(sorted(x.lower().split())), " ".join(sorted(y.lower().split()))
        if not x and not y:
            return 1.0
        # Bit-parallel longest common subsequence (Hyyro 2004).
        masks: dict[str, int] = {}
        for i, ch in enumerate(x):
            masks[ch] = masks.get(ch, 0) | 1 << i
        full = (1 << len(x)) - 1
        v = full
        for ch in y:
            u = v & masks.get(ch, 0)
            v = ((v + u) | (v - u)) & full
        return 2 * (len(x) - v.bit_count()) / (len(x) + len(y))

    return pd.Series([None if p is None or q is None else one(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")


def fuzzy_pairs(entity: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(a, b, score) of pairs in a type whose labels' token-sort ratio reaches the threshold.

    Blocks lose no pair. A ratio of t keeps lengths within a factor of t / (2 - t) and lets at most
    d = (1 - t) of both lengths' characters differ; so of eight groups of letters one has equal counts
    if d is under eight. Labels are joined on their type, length and such a count; longer ones on type
    and length alone. Labels that are equal but for case and word order are one.
    """
    base = entity.select("entity_type", F.array_join(F.array_sort(F.split(F.lower("label"), r"(?U)\s+")), " ").alias("s"), "id").where("s is not null")
    one = base.groupBy("entity_type", "s").agg(F.min("id").alias("id"))
    n = F.length("s")
    lo, hi = F.ceil(n * threshold / (2 - threshold)).cast("int"), F.floor(n * (2 - threshold) / threshold).cast("int")
    groups = 8
    letters = [F.length(F.regexp_replace("s", f"[^{cls}]", "")) for cls in ("ae", "iou", "rst", "ln", "bcdf", "ghjkmp", "qvwxyz", r"\x00-\x60\x7b-\x{10ffff}")]
    keys = F.array(*[F.concat(F.lit(f"{i}:"), c.cast("string")) for i, c in enumerate(letters[:groups])])
    small = F.floor(hi * (2 - 2 * threshold)).cast("int") < groups
    signed = one.withColumn("n", n).withColumn("small", small).withColumn("lo", lo).withColumn("hi", hi)
    left = signed.select("entity_type", F.col("id").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na"), F.col("small").alias("fa"), F.explode(F.sequence("lo", "hi")).alias("nb"), keys.alias("ka"))
    left = left.withColumn("k", F.explode(F.when(F.col("fa"), F.col("ka")).otherwise(F.array(F.lit("*")))))
    right = signed.select("entity_type", F.col("id").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"), F.explode(F.concat(keys, F.array(F.lit("*")))).alias("k"))
    pairs = left.join(right, ["entity_type", "nb", "k"]).where("a < b").select("a", "b", "sa", "sb").distinct()
    return pairs.withColumn("score", token_sort_ratio("sa", "sb")).where(F.col("score") >= threshold).select("a", "b", "score")


def cosine_pairs(entity: DataFrame, threshold: float = COSINE, exclude: tuple[str, ...] = X.STANCE_TYPES) -> DataFrame:
    """(a, b, cosine) of pairs in a type at or above the threshold; types that carry a stance never match."""
    base = entity.where(F.col("embedding").isNotNull() & ~X.stance_bearing(F.col("entity_type"), exclude))
    return cosines(base, "entity_type", "id", "embedding", threshold)


def greedy(entity: DataFrame, pairs: DataFrame, order: str = "ord") -> DataFrame:
    """(id, canonical) as a single pass in order would give: an entity joins the best representative before it, or becomes one.

    Matches are not transitive. In rounds, an undecided entity is no representative as soon as one
    before it that it matches is one, whichever it will join; it is one when all of these are known not
    to be. Every round decides the first that is open, so rounds go on until none is. Then each entity
    joins the matching representative of the best score, first in order, or stands for itself.
    """
    score = next(c for c in pairs.columns if c not in ("a", "b"))
    at = entity.select("id", F.col(order).alias("o"))
    p = pairs.select("a", "b", F.col(score).alias("s")).join(at.select(F.col("id").alias("a"), F.col("o").alias("oa")), "a").join(at.select(F.col("id").alias("b"), F.col("o").alias("ob")), "b").where("ob <> oa")
    turn = lambda x, y: F.when(F.col("ob") < F.col("oa"), F.col(x)).otherwise(F.col(y))
    p = p.select(turn("a", "b").alias("a"), turn("b", "a").alias("b"), "s", turn("oa", "ob").alias("oa"), turn("ob", "oa").alias("ob"))
    p = materialise(p, "greedy-pairs")
    later = p.select(F.col("a").alias("id")).distinct()
    state = at.select("id").join(later.withColumn("later", F.lit(True)), "id", "left").select("id", F.when(F.col("later"), F.lit(None)).otherwise(True).cast("boolean").alias("stands"))
    state = materialise(state, "greedy")
    while not state.where("stands is null").isEmpty():
        known = state.select(F.col("id").alias("b"), F.col("stands").alias("first"))
        view = p.join(known, "b").groupBy(F.col("a").alias("id")).agg(F.bool_or(F.coalesce("first", F.lit(False))).alias("joins"), F.bool_or(F.col("first").isNull()).alias("wait"))
        decided = F.when(F.col("joins"), False).when(~F.col("wait"), True)
        after = materialise(state.join(view, "id", "left").select("id", F.coalesce("stands", decided).alias("stands")), "greedy")
        discard(state)
        state = after
    heads = state.where("stands").select(F.col("id").alias("b"))
    best = p.join(heads, "b").groupBy(F.col("a").alias("id")).agg(F.max(F.struct("s", (-F.col("ob")).alias("o"), "b")).alias("best"))
    return state.join(best, "id", "left").select("id", F.coalesce("best.b", "id").alias("canonical"))


def field_keys(entity: DataFrame) -> DataFrame:
    """(id, type, reg_id, address, jurisdiction, name) in normal form, each once; blanks are null, so they never meet."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return entity.select(
        "id", F.col("entity_type").alias("type"), X.norm_reg(F.col("reg_id")).alias("reg_id"), blank(X.norm_address(F.col("address"))).alias("address"),
        blank(X.norm_field(F.col("jurisdiction"))).alias("jurisdiction"), X.norm_name(F.col("label")).alias("name"),
    ).distinct()


BY_REG, BY_PLACE = ("type", "reg_id"), ("type", "name", "address")
#: Rows of a tile of a block, about; a pair of tiles is a task's share of the block's pairs.
BLOCK_TILE = 4096


def block_pairs(base: DataFrame, block: tuple[str, ...], carried: tuple[str, ...] = ()) -> DataFrame:
    """(id_a, id_b, carried fields of both) of all pairs with id_a < id_b that share the block's fields, none of them null.

    A block is dealt into tiles by a hash of its ids, and pairs of tiles are joined, so a block of any
    size is many tasks' work; nothing else is shuffled, and nothing after the join.
    """
    rows = base.select("id", *block, *[c for c in carried if c not in block]).where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*block, "id")]))
    rows = rows.select("id", F.xxhash64(*block).alias("_h"), *[c for c in rows.columns if c != "id"])
    sizes = rows.groupBy("_h").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TILE).alias("_n")).where("_n > 1")
    dealt = rows.join(sizes, "_h", "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_t", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_n")))
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    every = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    # Of a cell (i, j) the left side is tile i, the right one tile j; both orders of tiles are cells.
    left = dealt.select(F.explode(F.transform(every, lambda x: cell(F.col("_t"), x))).alias("_c"), "_h", *[F.col(c).alias(f"{c}_a") for c in rows.columns if c != "_h"])
    right = dealt.select(F.explode(F.transform(every, lambda x: cell(x, F.col("_t")))).alias("_c"), "_h", *[F.col(c).alias(f"{c}_b") for c in rows.columns if c != "_h"])
    parts = 4 * partitions(base.sparkSession)
    keyed = lambda d: d.select("_h", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"), *[c for c in d.columns if c not in ("_h", "_c")]).repartition(parts, "_h", "_i", "_j")
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_a") == F.col(f"{c}_b") for c in block])
    pairs = keyed(left).join(keyed(right).hint("shuffle_hash"), ["_h", "_i", "_j"]).where(same & (F.col("id_a") < F.col("id_b")))
    return pairs.select("id_a", "id_b", *[F.col(f"{c}_{s}") for s in "ab" for c in dict.fromkeys((*block, *carried))])


_FIELDS = ("type", "reg_id", "address", "jurisdiction", "name")


def candidate_pairs(base: DataFrame) -> DataFrame:
    """All pairs that share a register number, or a name and an address: those of the second kind without those of the first."""
    pairs = block_pairs(base, BY_PLACE, _FIELDS).where(~F.coalesce(F.col("reg_id_a") == F.col("reg_id_b"), F.lit(False)))
    first = block_pairs(base, BY_REG, _FIELDS)
    return first.union(pairs.select(*first.columns))


def decided_pairs(base: DataFrame) -> DataFrame:
    """(a, b, decision, reason) of all candidates."""
    part = lambda s: {c: F.col(f"{c}_{s}") for c in _FIELDS}
    decision, reason = X.decide(part("a"), part("b"))
    return candidate_pairs(base).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), decision.alias("decision"), reason.alias("reason"))


def merged(entity: DataFrame, base: DataFrame) -> DataFrame:
    """(id, canonical) that the pairs decided as merges unite, without forming the pairs.

    Of one register number and address, rows of one jurisdiction merge, and a row without one merges
    with all; of rows without a register number, those of one name and address merge. So a link from
    each row to one of its class, and one from each class to a row without jurisdiction, unite the same.
    """
    whole = base.where("id is not null and type is not null and address is not null")
    reg = whole.where("reg_id is not null")
    at = ["type", "reg_id", "address"]
    free = reg.where("jurisdiction is null").groupBy(*at).agg(F.min("id").alias("free"))
    own = reg.where("jurisdiction is not null").groupBy(*at, "jurisdiction").agg(F.min("id").alias("own"))
    known = reg.join(free, at, "left").join(own, [*at, "jurisdiction"], "left").select("id", F.coalesce("free", "own").alias("to"))
    place = ["type", "name", "address"]
    bare = whole.where("reg_id is null and name is not null")
    alike = bare.join(bare.groupBy(*place).agg(F.min("id").alias("to")), place).select("id", "to")
    comp = connected_components(known.union(alike), "id", "to")
    return entity.select("id").join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("canonical"))


def multifield(entity: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id map, pairs decided, candidates): register numbers, addresses and names decide; only merges unite.

    Candidates share a type and a register number, or a type, name key and address. All pairs of a block
    are decided, since a person reviews pairs; blocks are as large as a register number, or a name at an
    address, has rows. The id map needs no pairs; decided and candidates are formed when they are read.
    """
    base = field_keys(entity)
    return merged(entity, base), decided_pairs(base), candidate_pairs(base)


def alias(entity: DataFrame, edge: DataFrame) -> DataFrame:
    """(id, canonical): ends of ALIAS_OF edges of one type are one; the longest label, then the largest id, stays."""
    kinds = entity.select("id", "entity_type")
    same = (
        edge.where("edge_type = 'ALIAS_OF'").select("source_id", "target_id")
        .join(kinds.select(F.col("id").alias("source_id"), F.col("entity_type").alias("_a")), "source_id")
        .join(kinds.select(F.col("id").alias("target_id"), F.col("entity_type").alias("_b")), "target_id").where("_a = _b")
    )
    comp = connected_components(same, "source_id", "target_id")
    member = entity.select("id", F.length("label").alias("n")).join(comp, F.col("id") == F.col("node"))
    keep = member.groupBy("component").agg(F.max(F.struct("n", "id")).alias("_k")).select("component", F.col("_k.id").alias("canonical"))
    return entity.select("id").join(comp.join(keep, "component").select(F.col("node").alias("id"), "canonical"), "id", "left").select("id", F.coalesce("canonical", "id").alias("canonical"))


def tiers(entity: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tiers in order: each gets the entities that still stand for themselves and maps some of them further."""
    done = entity.select("id", F.col("id").alias("canonical"))
    for step in steps:
        standing = entity.join(done.where("id = canonical").select("id"), "id", "left_semi")
        more = step(standing).select(F.col("id").alias("canonical"), F.col("canonical").alias("_next"))
        done = materialise(done.join(more, "canonical", "left").select("id", F.coalesce("_next", "canonical").alias("canonical")), "tier")
    return done


def merge_records(entity: DataFrame, id_map: DataFrame, via: str) -> DataFrame:
    """An audit row for each entity merged into another."""
    kept = entity.select(F.col("id").alias("canonical"), F.col("label").alias("kept_label"))
    moved = id_map.where("id <> canonical").join(entity.select("id", "label", "entity_type"), "id").join(kept, "canonical")
    return moved.select(F.col("canonical").alias("kept"), F.col("id").alias("merged"), "kept_label", "label", "entity_type", F.lit(via).alias("via"))


def fellegi_sunter(entity: DataFrame, threshold: float = 0.9, rounds: int = 20) -> DataFrame:
    """(id, canonical) by probabilistic linkage of names (Fellegi and Sunter 1969).

    Pairs share a type and a name key's first word; three comparisons (whole key within two edits, last
    word, length) make eight patterns. The expectation-maximisation runs on the counts of patterns, which is
    all that reaches the driver. Counts come from automata and histograms, and links from shared remainders of keys,
    so a first word that all have costs no pair of each; only if the sure patterns are not all those that agree in
    some comparisons are the pairs formed. Under four entities, or without pairs, everyone is themselves.
    """
    key = X.norm_name(F.col("label"))
    base = entity.select("id", "entity_type", key.alias("k")).where("k is not null")
    words = F.split("k", " ")
    one = base.groupBy("entity_type", "k").agg(F.min("id").alias("rep")).withColumn("first", words[0]).withColumn("last", F.element_at(words, -1))
    one = materialise(one, "fs")
    counts = L.patterns(one)
    same = by_key(entity.withColumn("_fs", F.col("id")), key, "_fs")
    if not counts or entity.limit(4).count() < 4:
        return same
    lam, m, u = 0.1, [0.9] * 3, [0.2] * 3
    odds: dict[int, float] = {}
    for _ in range(rounds):
        for p in counts:
            a, b = lam, 1 - lam
            for i in range(3):
                on = p >> i & 1
                a, b = a * (m[i] if on else 1 - m[i]), b * (u[i] if on else 1 - u[i])
            odds[p] = a / (a + b)
        total, match = sum(counts.values()), sum(n * odds[p] for p, n in counts.items())
        lam = min(0.999, max(1e-6, match / total))
        for i in range(3):
            on = [(n, odds[p]) for p, n in counts.items() if p >> i & 1]
            m[i] = min(0.999, max(0.001, sum(n * o for n, o in on) / max(1e-9, match)))
            u[i] = min(0.999, max(0.001, sum(n * (1 - o) for n, o in on) / max(1e-9, total - match)))
    sure = [p for p, o in odds.items() if o >= threshold]
    comp = connected_components(L.links(one, set(counts), set(sure)), "rep", "head")
    return same.join(comp, F.col("canonical") == F.col("node"), "left").select("id", F.coalesce("component", "canonical").alias("canonical"))
