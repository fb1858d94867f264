"""SimHash near-dedup: pigeonhole blocks, a join on blocks, verified Hamming distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.memory import lean
from dossier.llm.near_copies import near_copies
from dossier.plans.components import connected_components
from dossier.session import discard, materialise

DISTANCE = 2
#: Blocks of 16 bits; at distance 2 at least two of four agree, so pairs of blocks are the keys.
BLOCKS = 4
#: Buckets of up to so many different fingerprints compare them directly; larger ones go by centres.
DIRECT = 24
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """Words in lists, so that a very long text isn't held as objects at once."""
    at = 0
    while at < len(raw):
        cut = len(raw)
        if at + _PIECE < len(raw) and (m := _WHITE.search(raw, at + _PIECE)):
            cut = m.start()
        yield raw[at:cut].split()
        at = cut


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits: the majority of the XXH64 (seed 42) of the text's shingles; 0 if it has no words."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for words in _words((text or "").encode().translate(_LOWER)):
        words = carry + words
        hashes = [digest(join(x), 42) for x in zip(*[words[k:] for k in range(width)], strict=False)]
        carry = words[-(width - 1) :] if width > 1 else []
        for i in range(0, len(hashes), 1 << 14):
            h = np.array(hashes[i : i + (1 << 14)], "<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return digest(join(carry), 42) if carry else 0
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * ones > total)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(lean("simhash", run), f"_id {kind}, fp long")


def _block_mask(kept: tuple[int, ...]) -> int:
    size = 64 // BLOCKS
    mask = sum(((1 << size) - 1) << (size * k) for k in kept)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints of one column fp, at most DISTANCE bits apart.

    All edges of a small bucket; of a large one enough that the same fingerprints stay connected:
    two values within two bits share a centre within one bit of both, and a centre's members, at
    most 65, form a star. So a bucket of n values costs at most 33 n rows and no link is lost.
    """
    keeps = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    masks = [_block_mask(k) for k in keeps]
    keyed = prints.select("fp", F.inline(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(keyed.join(sizes, ["t", "key"]), "blocks")
    few = shared.where(F.col("n") <= DIRECT)
    direct = (
        few.select("t", "key", F.col("fp").alias("a"))
        .join(few.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
        .select("a", "b")
    )
    flips = [0, *[1 << k if k < 63 else -(1 << 63) for k in range(64)]]
    free = {i: [x for x in flips if x == 0 or not x & m] for i, m in enumerate(masks)}
    choice = F.array(*[F.array(*[F.lit(x) for x in free[i]]) for i in range(len(masks))])
    centres = (
        shared.where(F.col("n") > DIRECT)
        .select("t", "fp", F.explode(F.get(choice, F.col("t"))).alias("flip"))
        .select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        .groupBy("t", "centre")
        .agg(F.sort_array(F.collect_set("fp")).alias("all"))
        .where("size(all) > 1")
        .select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    )
    return direct.union(centres).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similarity: float | None = None) -> DataFrame:
    """One row per row of docs: id and component_id, the smallest id reachable over links.

    Without a similarity, links are pairs of fingerprints at most two bits apart, and there are two
    more columns, fingerprint (16 hex digits) and group_size. With one, links are pairs of texts whose
    sets of shingles have at least that Jaccard similarity: those that the fingerprints show are
    proven on the sets, and a prefix join finds the others (64 bits can't: at a similarity of 0.8 two
    fingerprints differ in about ten bits, where pigeonhole blocks of a useful size rarely agree).

    Work on links is done once for each different fingerprint or set, so a group of copies of any size
    is one node. Null and empty texts have no words and the fingerprint zero, linked like any other
    (by similarity: to each other); a null id is never the smallest unless all are null. Repeated rows
    are rows. Texts of any length are read whole. Extra columns are ignored.
    """
    if similarity is not None:
        return near_copies(docs, links, width, similarity, id_col, text_col)
    rows = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("n")), "prints")
    comp = connected_components(links(prints.select("fp")), "a", "b")
    rooted = prints.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("root"))
    rooted = materialise(rooted, "roots")
    discard(prints)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("group_size"))
    named = rooted.select("fp", "root").join(lows, "root").select("fp", "component_id", "group_size")
    return rows.join(named, "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")
