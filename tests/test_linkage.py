"""Counts and links of close names against all pairs of plain Python."""

import random
from itertools import combinations

import pytest

from dossier.operators import linkage as L
from dossier.operators import resolve as Z
from dossier.plans.components import connected_components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def pattern(a, b):
    return 4 * (edits(a, b) <= 2) + 2 * (a.split()[-1] == b.split()[-1]) + (abs(len(a) - len(b)) <= 1)


def united(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def names():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randint(0, n)))
    return sorted({" ".join(x for x in ("x", word(7), rng.choice(["", "", "ba", "cab"])) if x) for _ in range(150)})


def test_close_counts_each_pair_once():
    words = names()
    by = {n: [w for w in words if len(w) == n] for n in {len(w) for w in words}}
    for n, a in by.items():
        assert (L.close(a, a) - len(a)) // 2 == sum(edits(x, y) <= 2 for x, y in combinations(a, 2))
        for more in (1, 2):
            b = by.get(n + more, [])
            assert L.close(a, b) == sum(edits(x, y) <= 2 for x in a for y in b)


@pytest.mark.parametrize("tile", [1 << 18, 20])
def test_patterns_and_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(L, "SMALL", 2)
    monkeypatch.setattr(L, "TILE", tile)
    words = names()
    rows = [("t", w, f"r{i:03d}", "x", w.split()[-1]) for i, w in enumerate(words)]
    one = spark.createDataFrame(rows, "entity_type string, k string, rep string, first string, last string")
    rep = {w: r[2] for w, r in zip(words, rows, strict=True)}
    pairs = {(a, b): pattern(a, b) for a, b in combinations(words, 2)}
    there = {p: list(pairs.values()).count(p) for p in set(pairs.values())}
    assert L.patterns(one) == there
    for sure in ([{7}, {4, 5, 6, 7}, {5, 7}] if tile > 20 else [{3, 7}, {5}]):
        got = {r.node: r.component for r in connected_components(L.links(one, set(there), sure & set(there)), "rep", "head").collect()}
        want = united(rep.values(), [(rep[a], rep[b]) for (a, b), p in pairs.items() if p in sure])
        assert {x: got.get(x, x) for x in rep.values()} == want, sure


def test_fellegi_sunter_forms_no_pairs_of_a_common_word(spark, monkeypatch):
    """20,000 names that begin with one word have 200 million pairs; those before were all written."""
    written, real = [], L._pairs
    monkeypatch.setattr(L, "_pairs", lambda rows, block: written.append(rows.count()) or real(rows, block))
    ent = spark.range(20_000).selectExpr("concat('e', id) id", "'person' entity_type", "format_string('Supplier#%09d', id) label")
    assert Z.fellegi_sunter(ent).count() == 20_000
    assert not any(written)
