"""Pairs of strings within two edits inside blocks: counted and linked without forming them."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.plans.components import connected_components
from dossier.session import materialise

#: Blocks of up to so many strings are compared pair by pair.
SMALL = 1000
#: Strings of a tile of a block, about; a pair of tiles is one task's.
TILE = 1 << 18
#: States held at once.
STATES = 1 << 20
_PAD = 0xFFFFFFFF


def _automaton(words: list[str], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth (first edge of each state, characters, next states); states with the same endings are one."""
    codes = np.full((len(words), width), _PAD, np.uint32)
    for i, w in enumerate(words):
        codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    codes = codes[np.lexsort(codes.T[::-1])] if width else codes
    differs = np.ones((len(words), width + 1), bool)  # whether the first t characters are another prefix
    differs[:, 0] = False
    differs[0, 0] = True
    if len(words) > 1:
        differs[1:, 1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
    state = np.zeros(int(differs[:, width].sum()), np.int64)
    levels = []
    for t in range(width - 1, -1, -1):
        rows = np.flatnonzero(differs[:, t + 1])
        char, first = codes[rows, t], np.flatnonzero(differs[rows, t])
        with np.errstate(over="ignore"):
            h = char.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + state.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
            sums = np.add.reduceat(h ^ (h >> np.uint64(31)), first)
        _, one, inverse = np.unique(sums, return_index=True, return_inverse=True)
        ends = np.append(first[1:], len(rows))
        n = (ends - first)[one]
        at = np.append(0, np.cumsum(n))
        take = np.repeat(first[one] - at[:-1], n) + np.arange(at[-1])
        levels.append((at, char[take], state[take]))
        state = inverse.astype(np.int64)
    return levels[::-1]


def close(a: list[str], b: list[str]) -> int:
    """How many pairs of a and b are within two edits; all of a have one length, all of b one from that to two more.

    Both automata are read together; a state of the pair is both states, five distances around the
    diagonal and the last two characters of each side. Equal states are one with a count.
    """
    if not a or not b:
        return 0
    width, more = len(b[0]), len(b[0]) - len(a[0])
    left = _automaton(a, width)
    right = left if a is b else _automaton(b, width)
    start = np.zeros((1, 11), np.int64)  # states; a, b: last but one, last; distances -2..2; the depth's count is apart
    start[0, 6:11] = 3, 3, 0, 3, 3
    total, stack = 0, [(0, start, np.ones(1, np.int64))]
    while stack:
        t, s, n = stack.pop()
        if t == width:
            total += int(n[s[:, 8 - more] <= 2].sum())
            continue
        (la, lc, ln), (ra, rc, rn) = left[t], right[t]
        da, db = la[s[:, 0] + 1] - la[s[:, 0]], ra[s[:, 1] + 1] - ra[s[:, 1]]
        size = np.cumsum(da * db)
        if size[-1] > STATES and len(s) > 1:
            cut = min(len(s) - 1, max(1, int(np.searchsorted(size, STATES))))
            stack += [(t, s[cut:], n[cut:]), (t, s[:cut], n[:cut])]
            continue
        row = np.repeat(np.arange(len(s)), da * db)
        k = np.arange(size[-1]) - np.repeat(size - da * db, da * db)
        ea, eb = la[s[row, 0]] + k // db[row], ra[s[row, 1]] + k % db[row]
        x, y, old = lc[ea].astype(np.int64), rc[eb].astype(np.int64), s[row]
        p2, p1, m, q1, q2 = (old[:, i] for i in range(6, 11))
        np2 = np.minimum(p2 + (old[:, 2] != y), p1 + 1)
        np1 = np.minimum(np.minimum(p1 + (old[:, 3] != y), m + 1), np2 + 1)
        nq2 = np.minimum(q2 + (old[:, 4] != x), q1 + 1)
        nq1 = np.minimum(np.minimum(q1 + (old[:, 5] != x), m + 1), nq2 + 1)
        nm = np.minimum(np.minimum(m + (x != y), np1 + 1), nq1 + 1)
        new = np.column_stack([ln[ea], rn[eb], old[:, 3], x, old[:, 5], y, *[np.minimum(c, 3) for c in (np2, np1, nm, nq1, nq2)]])
        live = (new[:, 6:11] <= 2).any(axis=1)
        new, n = new[live], n[row][live]
        # Characters that no distance within two edits will be compared with make no difference.
        new[new[:, 6] > 2, 2] = 0
        new[(new[:, 6] > 2) & (new[:, 7] > 2), 3] = 0
        new[new[:, 10] > 2, 4] = 0
        new[(new[:, 10] > 2) & (new[:, 9] > 2), 5] = 0
        if len(new):
            order = np.lexsort(new.T)
            new, n = new[order], n[order]
            first = np.flatnonzero(np.append(True, (new[1:] != new[:-1]).any(axis=1)))
            stack.append((t + 1, new[first], np.add.reduceat(n, first)))
    return total


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    a, b = rows.k[rows.side == 0].tolist(), rows.k[rows.side == 1].tolist()
    more, own = int(rows.more.iloc[0]), bool((rows.i == rows.j).iloc[0])
    n = (close(a, a) - len(a)) // 2 if more == 0 and own else close(a, b)
    return pd.DataFrame({"near": [more < 2], "n": [n]})


def _blocks(one: DataFrame, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of blocks of two to SMALL strings, rows of larger ones with their _n)."""
    sizes = one.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sized = one.join(sizes, block)
    return sized.where(F.col("_n") <= SMALL), sized.where(F.col("_n") > SMALL)


def _near(c: str = "k") -> Column:
    return F.abs(F.length(f"{c}_a") - F.length(f"{c}_b")) <= 1


def _pairs(rows: DataFrame, block: list[str]) -> DataFrame:
    side = lambda s: rows.select(*block, F.col("rep").alias(f"rep_{s}"), F.col("k").alias(f"k_{s}"))
    return side("a").join(side("b"), block).where("rep_a < rep_b").where(F.levenshtein("k_a", "k_b", 2) >= 0)


def close_counts(one: DataFrame, block: list[str]) -> tuple[int, int]:
    """Pairs of a block's strings (rep, k, each once) within two edits: of lengths at most one apart, and others."""
    small, large = _blocks(one, block)
    counts = _pairs(small, block).groupBy(_near().alias("near")).agg(F.count(F.lit(1)).alias("n"))
    if not large.isEmpty():
        size = F.length("k")
        tiles = F.ceil(F.col("_n") / TILE).cast("int")
        # A tile has all strings that differ in their last four characters only, so endings are shared.
        tile = F.pmod(F.xxhash64(F.substring("k", F.lit(1), F.greatest(size - 4, F.lit(0)))), tiles).cast("int")
        dealt = large.select(F.xxhash64(*block).alias("_b"), "k", size.alias("_l"), tiles.alias("_t"), tile.alias("_i"))
        every = F.sequence(F.lit(0), F.col("_t") - 1)
        own, length = F.col("_i"), F.col("_l")
        cell = lambda more, l, i, j, side: F.struct(F.lit(more).alias("more"), l.alias("l"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
        cells = [F.transform(F.filter(every, lambda x: x >= own), lambda x: cell(0, length, own, x, 0)), F.transform(F.filter(every, lambda x: x < own), lambda x: cell(0, length, x, own, 1))]
        for more in (1, 2):
            cells.append(F.transform(every, partial(lambda m, x: cell(m, length, own, x, 0), more)))
            cells.append(F.transform(every, partial(lambda m, x: cell(m, length - m, x, own, 1), more)))
        rows = dealt.select("_b", "k", F.explode(F.concat(*cells)).alias("c")).select("_b", "k", "c.*")
        # Lengths differ by more than nothing: tile i of the one and tile i of the other are two sides.
        rows = rows.withColumn("j", F.when(F.col("more") > 0, F.col("j") + F.lit(1 << 20)).otherwise(F.col("j")))
        counts = counts.union(rows.groupBy("_b", "more", "l", "i", "j").applyInPandas(_cell, "near boolean, n long"))
    found = {r[0]: r[1] for r in counts.groupBy("near").agg(F.sum("n")).collect()}
    return found.get(True) or 0, found.get(False) or 0


def all_counts(one: DataFrame, block: list[str]) -> tuple[int, int]:
    """All pairs of a block: of lengths at most one apart, and others; from the lengths' counts."""
    sizes = one.groupBy(*block, F.length("k").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    beside = sizes.select(*block, (F.col("_l") - 1).alias("_l"), F.col("_n").alias("_m"))
    near = sizes.join(beside, [*block, "_l"], "left").agg(F.sum(F.expr("_n * (_n - 1) div 2 + _n * coalesce(_m, 0)"))).first()[0] or 0
    every = one.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.expr("_n * (_n - 1) div 2"))).first()[0] or 0
    return near, every - near


def _linked(rows: DataFrame, block: list[str], keys: Column) -> DataFrame:
    """Links of all that have a key to the first that is a centre of it. keys: structs (kind, s, centre)."""
    k = rows.select("rep", *block, F.explode(keys).alias("c")).select("rep", F.xxhash64(*block, "c.kind", "c.s").alias("x"), F.xxhash64(F.lit(1), *block, "c.kind", "c.s").alias("y"), F.col("c.centre").alias("centre"))
    heads = k.where("centre").groupBy("x", "y").agg(F.min("rep").alias("head"))
    return k.join(heads, ["x", "y"]).where("rep <> head").select("rep", "head").distinct()


def close_links(one: DataFrame, block: list[str], near: bool) -> DataFrame:
    """(rep, head) links, each of them a pair within two edits, that unite what all such pairs of a block unite.

    near: of lengths at most one apart only. In large blocks two edits are found by what is left of the
    strings: two places masked or one character dropped from both makes any two a pair; where one is shorter,
    it is a pair with each of the longer ones, so it is the centre. Keys of two places are made only for
    blocks that keys of one place leave apart.
    """
    small, large = _blocks(one, block)
    pairs = _pairs(small, block)
    links = (pairs.where(_near()) if near else pairs).select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("head"))
    if large.isEmpty():
        return links
    key = lambda kind, s, centre=True: F.struct(F.lit(kind).alias("kind"), s.alias("s"), F.lit(centre).alias("centre"))
    without = lambda s, p, mark="": F.concat(F.substring(s, F.lit(1), p - 1), F.lit(mark), F.substring(s, p + 1, F.length(s)))
    places = lambda n, low=F.lit(1): F.when(n >= low, F.sequence(low, n)).otherwise(F.array().cast("array<int>"))
    s, n = F.col("k"), F.length("k")
    first = F.concat(F.transform(places(n), lambda p: key("mask", without(s, p, "\0"))), F.transform(places(n), lambda p: key("drop", without(s, p))))
    large = materialise(large.select("rep", "k", *block), "linkage")
    ones = materialise(_linked(large, block, first), "linkage")
    comp = connected_components(ones, "rep", "head")
    known = large.join(comp, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = known.groupBy(*block).agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a <> _b").select(*block)
    rest = large.join(open_, block, "left_semi")
    if rest.isEmpty():
        return links.union(ones)
    two = F.flatten(F.transform(places(n), lambda p: F.transform(places(n, p + 1), lambda q: key("masks", without(without(s, p, "\0"), q, "\0")))))
    short = F.transform(places(n), lambda p: key("mix", without(s, p, "\0")))
    long = F.flatten(F.transform(places(n), lambda p: F.transform(places(n - 1), lambda q: key("mix", without(without(s, p), q, "\0"), False))))
    kinds = [two, short, long]
    if not near:
        kinds += [F.array(key("drops", s)), F.flatten(F.transform(places(n), lambda p: F.transform(places(n - 1, p), lambda q: key("drops", without(without(s, p), q), False))))]
    return links.union(ones).union(_linked(rest, block, F.array_distinct(F.concat(*kinds))))


def all_links(one: DataFrame, block: list[str], near: bool) -> DataFrame:
    """(rep, head) links that unite all of a block, or of it what lengths at most one apart unite."""
    by = [*block, F.length("k").alias("_l")] if near else block
    heads = one.groupBy(*by).agg(F.min("rep").alias("head"))
    keys = [*block, "_l"] if near else block
    links = one.withColumn("_l", F.length("k")).join(heads, keys).select("rep", "head")
    if near:
        links = links.union(heads.join(heads.select(*block, (F.col("_l") - 1).alias("_l"), F.col("head").alias("rep")), keys).select("rep", "head"))
    return links.where("rep <> head")


BLOCK, WITH_LAST = ["entity_type", "first"], ["entity_type", "first", "last"]


def patterns(one: DataFrame) -> dict[int, int]:
    """How many pairs have each pattern that occurs: 4 for keys within two edits, 2 for one last word, 1 for lengths at most one apart."""
    pairs, last = all_counts(one, BLOCK), all_counts(one, WITH_LAST)
    edit, both = close_counts(one, BLOCK), close_counts(one, WITH_LAST)
    out = {}
    for bit, a, b, c, d in zip((1, 0), pairs, last, edit, both, strict=True):
        out |= {6 + bit: d, 4 + bit: c - d, 2 + bit: b - d, bit: a - b - c + d}
    return {p: n for p, n in out.items() if n}


def links(one: DataFrame, there: set[int], sure: set[int]) -> DataFrame:
    """(rep, head) links that unite what the pairs of the sure patterns unite; there: the patterns that occur."""
    agree = [c for c in range(8) if (up := {p for p in there if p & c == c}) and up <= sure]
    agree = [c for c in agree if not any(d != c and c & d == d for d in agree)]
    if {p for p in there if any(p & c == c for c in agree)} == sure:
        out = one.select("rep", F.col("rep").alias("head")).limit(0)
        for c in agree:
            out = out.union((close_links if c & 4 else all_links)(one, WITH_LAST if c & 2 else BLOCK, bool(c & 1)))
        return out
    bit = lambda c: c.cast("int")
    side = lambda s: one.select(*BLOCK, *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "k", "last")])
    pattern = bit(F.levenshtein("k_a", "k_b", 2) >= 0) * 4 + bit(F.col("last_a") == F.col("last_b")) * 2 + bit(_near())
    return side("a").join(side("b"), BLOCK).where("rep_a < rep_b").where(pattern.isin(*sure)).select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("head"))
