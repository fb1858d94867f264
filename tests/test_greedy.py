"""Greedy resolution against a sequential pass."""

import random

import pytest

from dossier.operators import resolve as Z
from dossier.queries import QUERIES


def one_pass(ids, pairs):
    """ids in order; pairs (a, b, score)."""
    at = {x: k for k, x in enumerate(ids)}
    near = {x: [] for x in ids}
    for a, b, s in pairs:
        near[a].append((b, s))
        near[b].append((a, s))
    out = {}
    for x in ids:
        reps = [(s, -at[y], y) for y, s in near[x] if at[y] < at[x] and out[y] == y]
        out[x] = max(reps)[2] if reps else x
    return out


@pytest.mark.parametrize("kind", ["clique", "random"])
def test_greedy_equals_a_pass(spark, kind):
    rng = random.Random(3)
    ids = [f"e{k:03d}" for k in range(80)]
    if kind == "clique":  # the nearest before is always the one just before
        pairs = [(ids[j], ids[k], 1.0 - (k - j) / 100) for k in range(80) for j in range(k)]
    else:
        pairs = [(ids[j], ids[k], rng.randrange(90, 100) / 100) for k in range(80) for j in range(k) if rng.random() < 0.06]
    ent = spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "id string, ord long")
    got = {r.id: r.canonical for r in Z.greedy(ent, spark.createDataFrame(pairs, "a string, b string, s double")).collect()}
    assert got == one_pass(ids, pairs)


def test_registered_query_resolves_the_table(spark, small):
    got = {str(r.id): str(r.canonical) for r in QUERIES["er_greedy"](spark, small).collect()}
    pairs = [(str(r.a), str(r.b), r.cosine) for r in QUERIES["er_cosine"](spark, small).collect()]
    ids = [str(r.vec_id) for r in spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()]
    assert got == one_pass(ids, pairs)
