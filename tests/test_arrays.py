"""Graph methods over arrays: several components in one call, numbers without gaps, and what is written once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from dossier.operators import graph


def test_louvain_of_several_components_is_the_one_by_joins(spark):
    rng, rows = random.Random(6), []
    for c in ("a", "é", "z"):
        pairs = {tuple(sorted((f"{c}{i}", f"{c}{rng.randrange(i)}"))) for i in range(1, 25)} | {tuple(sorted((f"{c}{rng.randrange(25)}", f"{c}{rng.randrange(25)}"))) for _ in range(20)}
        rows += [(u, v, f"{c}0") for u, v in sorted(pairs) if u != v]
    rng.shuffle(rows)
    got = graph.louvain_of(pa.table({n: [r[k] for r in rows] for k, n in enumerate(("u", "v", "component"))}))
    want = graph.louvain_wide(spark.createDataFrame(rows, "u string, v string, component string"))
    assert sorted(zip(*got.to_pydict().values(), strict=True)) == sorted(map(tuple, want.select("id", "community").collect()))


def test_numbers_have_no_gaps(spark):
    ids = spark.range(1000).select(F.concat(F.lit("x"), "id").alias("id")).repartition(7, "id")
    got = sorted((r.k, r.id) for r in graph._numbered(ids).collect())
    assert [k for k, _ in got] == list(range(1000)) and len({x for _, x in got}) == 1000


def test_a_million_edges_are_one_task_and_communities_are_written(spark):
    assert graph.COMPONENT_EDGES >= 1_500_000 and graph.LOT_EDGES <= 200_000
    edge = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source_id string, target_id string")
    assert "FlatMapGroups" not in graph.communities(edge)._jdf.queryExecution().optimizedPlan().toString()
