"""Near copies of the pipeline against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import bitmap, near_copies, simhash
from dossier.plans import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def groups(rows, width=5):
    """The smallest id of each row's group, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


@pytest.fixture(scope="module")
def rows(spark, small):
    rng = random.Random(7)
    out = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    line = [word() for _ in range(30)]
    for k in range(40):  # copies with words changed, around the threshold; all hold a common line
        base = [word() for _ in range(rng.randrange(3, 150))] + line
        for c in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = word()
            out.append((50_000 + 10 * k + c, " ".join(w).upper() if c % 2 else "\n".join(w)))
    base = [word() for _ in range(120)]
    for k in range(60):  # a large group
        w = list(base)
        w[rng.randrange(120)] = word()
        out.append((60_000 + k, " ".join(w)))
    return out + [(90_001, None), (90_002, ""), (90_003, " \t"), (90_004, "one"), (90_005, "ONE"), (90_006, "two words")]


@pytest.mark.parametrize("rounds", [2, 0])
def test_near_copies(spark, rows, rounds, monkeypatch):
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    if not rounds:  # an order that tells nothing, and all pairs of each bucket
        monkeypatch.setattr(near_copies, "_order", lambda texts, width: (16, np.zeros(1 << 16, np.uint8)))
    want = groups(rows)
    assert len(set(want.values())) < len(rows) - 80
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit(1) for c in ("_id", "_text", "k", "sid", "row", "i", "x", "n")})
    got = simhash.near_duplicates(df, width=5, similarity=0.8).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want


def test_a_large_group_costs_few_pairs_a_text(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(90_000)}"
    base = [word() for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 700):  # one to six words changed: up to three are near copies of the base, most of the others of none
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(150)] = word()
        rows.append((k, " ".join(w)))
    pairs, write = [], near_copies.materialise

    def counted(df, label):
        out = write(df, label)
        if label == "near-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, width=5, similarity=0.8).collect()}
    assert got == groups(rows)
    assert sum(pairs) < 6 * len(rows), pairs


def tables_of(monkeypatch):
    """The labels of the tables that near_copies and components write from now on."""
    labels = []

    def noted(df, label, write=components.materialise):
        labels.append(label)
        return write(df, label)

    for module in (near_copies, components):
        monkeypatch.setattr(module, "materialise", noted)
    return labels


def test_small_buckets_take_one_round(spark, monkeypatch):
    # Each query leaves threads and code in the driver, so a table without large buckets must not take the rounds of one that has some.
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(90_000)}" for _ in range(120)]
        for c in range(1 + k % 4):
            w = list(base)
            w[rng.randrange(120)] = f"x{c}"
            rows.append((10 * k + c, " ".join(w)))
    labels = tables_of(monkeypatch)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=0.8).collect()}
    assert got == groups(rows) and len(set(got.values())) == 60
    assert labels.count("near-pairs") == 1 and len(labels) <= 25, labels


def test_stars_are_components_without_a_round(spark, monkeypatch):
    labels = tables_of(monkeypatch)
    edges = spark.createDataFrame([(7, 1), (1, 3), (9, 1), (4, 8), (5, 5), (None, 2), (1, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {1: 1, 3: 1, 7: 1, 9: 1, 4: 4, 8: 4} and labels == ["cc"]
    assert components.connected_components(edges.limit(0), "a", "b").count() == 0
    # A path, and two hubs with one node in common: no stars yet.
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 103), (101, 103), (101, 102)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 104), 100)}


def test_a_full_bitmap_loses_nothing(spark):
    df, keys = spark.range(0, 3000), spark.range(0, 3000, 7)
    for most in (1 << 15, 1 << 26):
        got = {r.id for r in bitmap.maybe_in(df, F.col("id"), keys, most).collect()}
        assert set(range(0, 3000, 7)) <= got and len(got) < 900
    assert bitmap.maybe_in(df, F.col("id"), keys.limit(0)).count() == 0
    got = bitmap.marked(df.withColumn("k", F.expr("nullif(id, 3)")), F.col("k"), keys, "m").where("m").collect()
    assert {r.id for r in got} >= {3, *range(0, 3000, 7)}


def test_histograms_never_part_similar_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: -(-9 * len(a) // 10)], rng.integers(0, 1 << 63, n // 10).astype(np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(a, b))
        assert near_copies._may_share(near_copies._histogram(a), near_copies._histogram(b), both)
        if n >= 40:
            other = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            assert not near_copies._may_share(near_copies._histogram(a), near_copies._histogram(other), int(0.89 * n))
    assert near_copies._histogram(np.arange(100, dtype=np.uint64)) == b""


def test_near_dedup_drops_near_copies(spark, rows, small):
    import corpus_pipeline

    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, small).collect()) == sorted(set(groups(rows).values()))


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), width=5, similarity=0.8).count() == 0
