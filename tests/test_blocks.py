"""Blocks of pairs by tiles, and merges without pairs, against plain loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import resolve as Z
from dossier.plans.components import connected_components
from dossier.queries import QUERIES


@pytest.fixture(scope="module")
def firms(spark):
    rng = random.Random(8)
    pick = lambda *x: rng.choice(x)
    rows = [(f"c{k}", pick("organization", "organization", "person", None), pick("Acme", "Bolt Inc.", "", "Cog"), pick("R1", "R2", "R3", "--", None), pick("1 A St", "2 B St", "", None), pick("US", "ca", "", None)) for k in range(150)]
    rows += [("c3", "organization", "Acme", "R1", "1 A St", "US"), rows[7], (None, "organization", "Acme", "R1", "1 A St", "US")]
    return spark.createDataFrame(rows, "id string, entity_type string, label string, reg_id string, address string, jurisdiction string")


def test_blocks_of_many_tiles(firms, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK_TILE", 3)
    base = Z.field_keys(firms)
    rows = base.collect()
    for block in (Z.BY_REG, Z.BY_PLACE):
        want = sorted((a.id, b.id) for a in rows for b in rows if None not in (a.id, b.id, *(a[c] for c in block)) and a.id < b.id and all(a[c] == b[c] for c in block))
        assert want and sorted(map(tuple, Z.block_pairs(base, block).select("id_a", "id_b").collect())) == want
    assert Z.candidate_pairs(base).count() == Z.candidate_pairs(base).distinct().count()


def test_merges_need_no_pairs(firms):
    ids, decided, _ = Z.multifield(firms)
    comp = connected_components(decided.where("decision = 'merge'"), "a", "b")
    want = firms.select("id").join(comp, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("canonical"))
    key = lambda r: (r[0] or "", r[1] or "")
    assert sorted(map(tuple, ids.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_pairs_are_not_sorted_after_the_join(spark, small):
    for name in ("f_decide", "j_block_reg", "j_block_nameaddr", "j_block_norm"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert not plan.lstrip().startswith(("Aggregate", "Deduplicate", "Distinct")) and "_h" in plan
