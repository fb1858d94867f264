"""Near copies by the Jaccard similarity of their shingle sets: SimHash links, a prefix join for the pairs these miss, exact proof, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.bitmap import maybe_in
from dossier.llm.memory import lean
from dossier.llm.words import rolling, slices, spans, utf8, word_hashes
from dossier.plans.components import connected_components
from dossier.session import discard, materialise

WIDTH, SIMILARITY = 5, 0.8
#: Cells of the sketch that puts common shingles last: a fourth of the corpus's shingles, at most 2^MOST_BITS (a byte each).
#: Its size changes the work, never the result.
LEAST_BITS, MOST_BITS = 16, 27
PAGE, FLUSH = 1 << 16, 1 << 20
#: Rounds before the last, in which all pairs still apart are compared: in the first each set of a bucket of more than PART
#: with the bucket's leader, then in random parts of about PART sets, in one of SOME large buckets each.
ROUNDS, PART, SOME = 2, 64, 4
_BASE = 0xA24BAED4963EE407
_LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The different shingle hashes of each text, sorted; a text of fewer words is one shingle, one of none has none."""
    for i, j in slices(column):
        data, at = utf8(column.slice(i, j - i))
        data = _LOWER[data]
        starts, ends, first = spans(data, at)
        w = word_hashes(data, starts, ends)
        runs = rolling(w, width, _BASE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(runs[a : b - width + 1]) if b - a >= width else rolling(w[a:b], b - a, _BASE) if b > a else runs[:0]


def _sid(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)


def _signed(sids: list[int]) -> pa.Array:
    return pa.array(np.array(sids, np.uint64).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def _majority(h: np.ndarray) -> int:
    """SimHash of a set of hashes: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 13):
        ones += np.unpackbits(h[i : i + (1 << 13)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _histogram(h: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of a power of two of ranges, four bits each; empty if a range has too many."""
    bits = max(3, (len(h) - 1).bit_length() - 1)
    n = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return b"" if n.max() > 15 else (n[::2] | n[1::2] << 4).astype(np.uint8).tobytes()


def _ranges(raw: bytes) -> np.ndarray:
    packed = np.frombuffer(raw, np.uint8)
    return np.stack([packed & 15, packed >> 4], axis=1).reshape(-1).astype(np.int64)


def _may_share(a: bytes, b: bytes, least: int) -> bool:
    """Whether two sets with these histograms can have so many hashes in common."""
    if not a or not b:
        return True
    x, y = _ranges(a), _ranges(b)
    while len(x) > len(y):
        x = x[::2] + x[1::2]
    while len(y) > len(x):
        y = y[::2] + y[1::2]
    return int(np.minimum(x, y).sum()) >= least


def _sketch(bits: int, width: int):
    """Of each page of cells, how many sets of a stretch of rows have a shingle in a cell (up to 255)."""

    def pages(cells: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        page, start = np.unique(cell >> np.uint64(16), return_index=True)
        bound = [*start.tolist(), len(cell)]
        low, n = (cell & np.uint64(PAGE - 1)).astype("<u2"), np.minimum(n, 255).astype(np.uint8)
        cols = [pa.array([x[a:b].tobytes() for a, b in zip(bound, bound[1:], strict=False)], pa.binary()) for x in (low, n)]
        return pa.RecordBatch.from_arrays([pa.array(page.astype(np.int64)), *cols], ["page", "low", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i, j in slices(b.column(0)):
                for h in _sets(b.column(0).slice(i, j - i), width):
                    held.append(h >> np.uint64(64 - bits))
                    n += len(h)
                    if n > FLUSH:
                        yield pages(held)
                        held, n = [], 0
        if n:
            yield pages(held)

    return run


def _levels(key, table):
    """A page's cells as sixteen times the logarithm of their counts over the corpus."""
    count = np.zeros(PAGE, np.int64)
    for low, n in zip(table.column("low"), table.column("n"), strict=True):
        count[np.frombuffer(low.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), np.uint8)
    return pa.table({"page": [key[0].as_py()], "level": pa.array([np.minimum(255, 16 * np.log2(1 + count)).astype(np.uint8).tobytes()], pa.binary())})


def _order(texts: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(bits, level of each cell): about how common the shingles of a cell are, by a sketch over all texts."""
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2.0, size / 6 / 4)))))
    found = texts.mapInArrow(lean("near", _sketch(bits, width)), "page long, low binary, n binary")
    level = np.zeros(1 << bits, np.uint8)
    for page, raw in found.groupBy("page").applyInArrow(_levels, "page long, level binary").toLocalIterator():
        level[page * PAGE : (page + 1) * PAGE] = np.frombuffer(raw, np.uint8)
    return bits, level


def _prefixes(width: int, share: Fraction, bits: int, level):
    """Of each text its set's hash, size, SimHash and histogram, and the rarest hashes: two sets as similar as asked for have one of these in common."""

    def prefix(h: np.ndarray) -> np.ndarray:
        n = len(h)
        return h[np.lexsort((h, level.value[h >> np.uint64(64 - bits)]))[: n - -(-share.numerator * n // share.denominator) + 1]] if n else h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(2)):
                part = b.slice(i, j - i)
                sets = list(_sets(part.column(2), width))
                kinds = [
                    part.column(0), part.column(1), _signed([_sid(h) for h in sets]), pa.array([len(h) for h in sets], pa.int32()), _signed([_majority(h) for h in sets]),
                    pa.array([_histogram(h) for h in sets], pa.binary()), _lists([prefix(h) for h in sets]),
                ]
                yield pa.RecordBatch.from_arrays(kinds, ["_id", "k", "sid", "n", "fp", "ranges", "prefix"])

    return run


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(0)):
                sets = list(_sets(b.column(0).slice(i, j - i), width))
                yield pa.RecordBatch.from_arrays([_signed([_sid(h) for h in sets]), _lists(sets)], ["sid", "hashes"])

    return run


def _possible(share: Fraction):
    """Pairs whose histograms allow the overlap that their sizes ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(k)).astype(np.int64) for k in (2, 4))
            # |A & B| / (na + nb - |A & B|) >= p / q  <=>  |A & B| >= p (na + nb) / (p + q)
            least = -(-share.numerator * (na + nb) // (share.numerator + share.denominator))
            ok = [_may_share(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes(), k) for x, y, k in zip(batch.column(3), batch.column(5), least.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class Corpus:
    """The texts and what is known of their sets."""

    def __init__(self, texts: DataFrame, rows: DataFrame, width: int, share: Fraction):
        self.texts, self.rows, self.width, self.share = texts, rows, width, share
        #: One row for each different set, and a text that has it.
        self.kinds = materialise(rows.groupBy("sid").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("ranges").alias("ranges"), F.min(F.struct("_id", "k")).alias("one"), F.min("_id").alias("low")), "near-kinds")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a < b) of sets those as similar as asked for; full sets are made only for pairs whose histograms allow it."""
        side = lambda k: self.kinds.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("ranges").alias(f"r{k}"))
        sized = F.least("na", "nb") * self.share.denominator >= F.greatest("na", "nb") * self.share.numerator
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(sized).select("a", "b", "na", "ra", "nb", "rb")
        tried = materialise(both.mapInArrow(lean("near", _possible(self.share)), "a long, b long"), "near-tried")
        if tried.isEmpty():
            return tried
        wanted = tried.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        wanted = materialise(self.kinds.join(wanted, "sid", "left_semi").select("one.*", F.col("sid").alias("s")), "near-wanted")
        keyed = self.texts.withColumn("k", F.xxhash64("_text")).withColumnRenamed("_id", "_i")
        # Texts that aren't wanted are dropped by a bitmap, so that few are read again and shuffled.
        some = maybe_in(keyed, F.col("k"), wanted.select("k")).join(wanted, ["k"]).where(F.col("_i").eqNullSafe(F.col("_id")))
        sets = some.select("_text").mapInArrow(lean("near", _whole(self.width)), "sid long, hashes array<long>").groupBy("sid").agg(F.first("hashes").alias("hashes"))
        sets = materialise(sets, "near-sets")
        side = lambda k: sets.select(F.col("sid").alias(k), F.col("hashes").alias(f"h{k}"))
        full = tried.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
        out = materialise(full.where(F.col("both") * self.share.denominator >= (F.size("ha") + F.size("hb") - F.col("both")) * self.share.numerator).select("a", "b"), "near-edges")
        discard(sets, wanted, tried)
        return out

    def by_simhash(self, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Edges between sets whose fingerprints links() joins, each proven on the sets themselves."""
        prints = materialise(self.kinds.where("n > 0").groupBy("fp").agg(F.min("sid").alias("lead")), "near-prints")
        name = lambda k: prints.select(F.col("fp").alias(k), F.col("lead").alias(f"l{k}"))
        far = links(prints.select("fp")).join(name("a"), "a").join(name("b"), "b").select(F.col("la").alias("s"), F.col("lb").alias("t"))
        same = self.kinds.where("n > 0").join(prints, "fp").where("sid <> lead").select(F.col("sid").alias("s"), F.col("lead").alias("t"))
        pairs = far.union(same).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
        out = self.alike(pairs)
        discard(prints)
        return out

    def by_prefixes(self, edges: DataFrame) -> DataFrame:
        """Components (node, component) of the sets that edges and all other similar pairs connect.

        Sets with a rare hash in common form a bucket. The first round settles the small ones, and
        compares each set of a large one with its leader: the set with the fewest hashes before those of
        large buckets, for its size. Near copies of one text have that text as leader, if it is there, or
        one near it, so that a row a set and bucket connects a large group. In the next rounds sets are
        dealt into parts of about PART in a random order that all buckets share, and compared within
        their part. Then those of a bucket are compared in pairs that no edges connect yet. A pair counts
        in a bucket only if its hash may be the first that both have. Leaders and parts set the order of
        work, never the result. A small bucket is done with the first round; where no large one is left,
        no round follows.
        """
        keyed = self.rows.groupBy("sid").agg(F.first("prefix").alias("prefix")).select(F.posexplode("prefix").alias("at", "h"), "sid")
        keyed = materialise(keyed, "near-keyed")
        keys = materialise(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "near-keys")
        shared = materialise(maybe_in(keyed, F.col("h"), keys).join(keys, "h").join(self.kinds.select("sid", "n"), "sid").select("h", "sid", "at", "n"), "near-buckets")
        discard(keyed, keys)
        comp, tested = connected_components(edges, "a", "b"), None
        for k in range(ROUNDS + 1):
            named = shared.join(comp, F.col("sid") == F.col("node"), "left").select("h", "sid", "at", "n", F.coalesce("component", "sid").alias("comp"))
            apart = named.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("h", "c")
            now = materialise(named.join(apart, "h"), "near-buckets")
            discard(shared)
            # The first round compares all pairs of a bucket of up to PART sets that are in different components, and these only grow.
            shared = now.where(F.col("c") > PART).select("h", "sid", "at", "n")
            shared._dossier_path = now._dossier_path
            # So many hashes must be in common; from the first of these on, both sets must have as many left.
            p, q = self.share.numerator, self.share.denominator
            least = F.ceil((F.col("n") + F.col("m")) * p / (p + q) - 1e-9)
            sized = (F.col("at") + least <= F.col("n")) & (F.col("at2") + least <= F.col("m"))
            pair = [F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")]
            dealt = now.withColumn("part", F.lit(0))
            if k < ROUNDS:
                place = F.shiftrightunsigned(F.xxhash64("sid", F.lit(k)), 11) / float(1 << 53)
                large = F.pmod(F.xxhash64("h", F.lit(k)), F.lit(SOME)) == 0 if k else F.lit(False)
                dealt = now.withColumn("part", F.floor(place * F.ceil(F.col("c") / PART))).where((F.col("c") <= PART) | large)
            other = dealt.select("h", "part", F.col("sid").alias("t"), F.col("at").alias("at2"), F.col("n").alias("m"), F.col("comp").alias("other"))
            pairs = dealt.withColumnRenamed("sid", "s").join(other, ["h", "part"]).where((F.col("comp") < F.col("other")) & sized).select(*pair)
            if k == 0 and ROUNDS:
                wide = now.where(F.col("c") > PART)
                own = wide.groupBy("sid").agg((F.max("at") + 1 - F.count(F.lit(1))).alias("own"))
                known = wide.join(own, "sid").withColumn("far", F.col("own") * (p + q) - F.col("n") * (q - p))
                lead = known.groupBy("h").agg(F.min(F.struct("far", "sid", "at", "n", "comp")).alias("lead"))
                lead = lead.select("h", F.col("lead.sid").alias("t"), F.col("lead.at").alias("at2"), F.col("lead.n").alias("m"), F.col("lead.comp").alias("other"))
                pairs = pairs.union(wide.withColumnRenamed("sid", "s").join(lead, "h").where((F.col("comp") != F.col("other")) & sized).select(*pair))
            pairs = pairs.distinct()
            pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "near-pairs")
            found = self.alike(pairs)
            if not found.isEmpty():  # a star for each component, and what connects these
                comp = connected_components(comp.select("node", "component").union(found).toDF("a", "b"), "a", "b")
            tested = pairs if tested is None else tested.union(pairs)
            if k == ROUNDS or shared.isEmpty():
                break
        discard(shared)
        return comp


def near_copies(docs: DataFrame, links: Callable[[DataFrame], DataFrame], width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, component_id, the smallest id reachable over pairs of similar texts.

    Two texts are similar if the sets of their shingles (words in lower case A-Z) have a Jaccard
    similarity as asked for. Pairs come from links(), which joins SimHash fingerprints of the sets, and
    then from a prefix join that finds the similar pairs whose fingerprints lie further apart. All are
    proven on the sets. Shingles are 64-bit hashes, sets too; but for a collision the result is
    exact. Two such sets of sizes n share one of their n - ceil(similarity n) + 1 first shingles in any
    common order; rare ones come first, so buckets are small. Texts without words are equal. A null id
    is never the smallest unless all are null. Work on pairs is done once for each different set.
    Repeated rows are rows; extra columns are ignored; an empty table gives an empty result.
    """
    share = Fraction(str(similarity))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    bits, level = _order(texts.select("_text"), width)
    shared = docs.sparkSession.sparkContext.broadcast(level)
    keyed = texts.select("_id", F.xxhash64("_text").alias("k"), "_text")
    rows = materialise(keyed.mapInArrow(lean("near", _prefixes(width, share, bits, shared)), f"_id {kind}, k long, sid long, n int, fp long, ranges binary, prefix array<long>"), "near-rows")
    shared.destroy()
    corpus = Corpus(texts, rows, width, share)
    comp = corpus.by_prefixes(corpus.by_simhash(links))
    rooted = corpus.kinds.select("sid", "low").join(comp, F.col("sid") == F.col("node"), "left").select("sid", "low", F.coalesce("component", "sid").alias("root"))
    rooted = materialise(rooted, "near-roots")
    named = rooted.select("sid", "root").join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("sid", "component_id")
    out = materialise(rows.select("_id", "sid").join(named, "sid").select(F.col("_id").alias(id_col), "component_id"), "near-groups")
    discard(rows, corpus.kinds, rooted)
    return out
