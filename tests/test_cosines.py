"""Cosines by tiles against plain sums over all pairs, with odd vectors, repeated ids and groups of many tiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import cosines as N
from dossier.operators import resolve as Z
from dossier.queries import QUERIES


def plain(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return None
    dot, a, b = (sum(p * q for p, q in zip(s, t, strict=True)) for s, t in ((x, y), (x, x), (y, y)))
    return dot / (math.sqrt(a) * math.sqrt(b)) if a and b else None


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cosines_of_odd_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "TILE", 4)
    monkeypatch.setattr(N, "ROWS", 3)
    rng = random.Random(3)
    ident = (lambda k: k) if kind == "long" else (lambda k: f"é{k}")
    rows = [(ident(k), k % 3, [rng.gauss(0, 1) for _ in range(5)]) for k in range(60)]
    rows += [(ident(60), 0, None), (ident(61), 0, [0.0] * 5), (ident(62), 0, [1.0, None, 1.0, 1.0, 1.0]), (ident(63), 0, [1.0, 2.0]), (ident(64), 0, [2.0, 4.0]), (ident(65), 0, [])]
    rows += [(ident(5), 2, [1.0] * 5), (None, 2, [1.0] * 5), (ident(70), None, [1.0] * 5), (ident(71), 7, [1.0] * 5)]
    rows += [(ident(80), 8, [1.0, 0.0, 1e-12]), (ident(81), 8, [0.0, 1.0, -1.0])]
    df = spark.createDataFrame(rows, f"vec {kind}, label int, e array<double>")
    order = lambda r: (*r[:2], r[2] is None, r[2] or 0.0)
    want = sorted(((a, b, plain(x, y)) for a, la, x in rows for b, lb, y in rows if None not in (a, b, la, lb) and la == lb and a < b), key=order)
    got = sorted(map(tuple, N.cosines(df, "label", "vec", "e").collect()), key=order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want, strict=True):
        assert (g[2] is None) == (w[2] is None) and (g[2] is None or g[2] == pytest.approx(w[2], abs=5.1e-7))
    # A cosine just below zero keeps its sign, as round() of the SQL does.
    assert math.copysign(1, next(r[2] for r in got if r[0] == ident(80))) == -1
    few = sorted(map(tuple, N.cosines(df, "label", "vec", "e", 0.5, True).select("key", "a", "b").collect()))
    assert few == sorted((la, a, b) for a, la, x in rows for b, lb, y in rows if None not in (a, b, la, lb) and la == lb and a < b and (plain(x, y) or 0) >= 0.5)


@pytest.mark.parametrize("name", ["f_cosine", "f_verdict", "er_cosine"])
def test_no_join_makes_pairs(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "FlatMapGroupsInArrow" in plan  # the join adds a group's number of tiles


def test_adjudicated_pairs_are_formed_once(spark):
    n = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            n.add(len(f))
            yield f

    pairs = spark.createDataFrame([(k, k + 1, k / 100) for k in range(100)], "a long, b long, s double").mapInPandas(count, "a long, b long, s double")
    sure, doubt = Z.adjudicate(pairs, 0.5, lambda p: p.where(F.col("a") % 2 == 0), 0.1)
    assert (sure.count(), doubt.count(), n.value) == (55, 5, 100)
