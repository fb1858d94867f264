"""From records to graph, and readers of gold notes."""

import pytest
from pyspark.sql import functions as F

from dossier.operators import resolve as Z
from dossier.operators import search as S
from dossier.plans import case
from dossier.sources import gold

ENT = "id string, entity_type string, label string, extraction_source string, ord long, reg_id string, address string, jurisdiction string"
EDGE = "source_id string, target_id string, edge_type string, amount double, currency string, extraction_source string, ord long"


@pytest.fixture(scope="module")
def chunk(spark):
    return spark.createDataFrame([("c1", "Acme Corp paid Jane Doe in Springfield."), ("c2", "J. Doe, also Jane  doe, met Robert Smith and Robert Smyth.")], "id string, body string")


def names(rows):
    return [(i, k, n, s, o, None, None, None) for o, (i, k, n, s) in enumerate(rows)]


def test_prose_batch_merges_by_spelling(spark, chunk):
    ent = spark.createDataFrame(names([("1", "person", "Jane Doe", "nlp"), ("2", "person", "jane doe", "nlp"), ("3", "person", "Robert Smith", "nlp"), ("4", "person", "Robert Smyth", "nlp"), ("5", "person", "Ghost", "nlp")]), ENT)
    edge = spark.createDataFrame([("1", "3", "MET", None, None, "nlp", 1), ("2", "4", "MET", None, None, "nlp", 2), ("5", "1", "MET", None, None, "nlp", 3)], EDGE)
    r = case.ground_and_resolve(chunk, ent, edge, fuzzy=0.9)
    assert {x.id: x.canonical for x in r.id_map.collect()} == {"1": "1", "2": "1", "3": "3", "4": "3"}
    assert [(x.source_id, x.target_id) for x in r.edge.collect()] == [("1", "3")]
    assert [x.id for x in r.quarantined["entity"].collect()] == ["5"] and [x.ord for x in r.quarantined["edge"].collect()] == [3]


def test_structured_batch_rescues_and_never_guesses(spark, chunk):
    ent = spark.createDataFrame(names([("1", "organization", "Acme Corp", "nlp"), ("2", "organization", "ACME, L.L.C.", "structured"), ("3", "organization", "Other Ltd", "structured"), ("4", "person", "Robert Smith", "nlp"), ("5", "person", "Robert Smyth", "nlp")]), ENT)
    edge = spark.createDataFrame([("2", "4", "PAID_TO", 2700.0, "USD", "structured", 1), ("1", "4", "PAID_TO", 3950.0, "USD", "structured", 2), ("3", "4", "PAID_TO", 1.0, "USD", "structured", 3)], EDGE)
    r = case.ground_and_resolve(chunk, ent, edge)
    assert {x.id: x.canonical for x in r.id_map.collect()} == {"1": "1", "2": "1", "4": "4", "5": "5"}
    assert [(x.source_id, x.amount) for x in r.edge.collect()] == [("1", 6650.0)]


def test_fields_decide_alone(spark, chunk):
    rows = [("1", "organization", "Acme Corp", "nlp", 1, "R1", "270 Park Ave", "US"), ("2", "organization", "Acme Corp", "nlp", 2, "R2", "1 Main St", "US"), ("3", "organization", "Acme Corp", "nlp", 3, "r1", "270 Park Avenue", "US"), ("4", "organization", "Acme Corp", "nlp", 4, "R2", "", "US")]
    r = case.ground_and_resolve(chunk, spark.createDataFrame(rows, ENT), spark.createDataFrame([], EDGE))
    assert {x.id: x.canonical for x in r.id_map.collect()} == {"1": "1", "2": "2", "3": "1", "4": "4"}
    assert [(x.a, x.b, x.reason) for x in r.pair_review.collect()] == [("2", "4", "address missing")]


def test_alias_edges_unite_and_vanish(spark, chunk):
    ent = spark.createDataFrame(names([("1", "person", "Jane Doe", "nlp"), ("2", "person", "J. Doe", "nlp"), ("3", "person", "Robert Smith", "nlp")]), ENT)
    edge = spark.createDataFrame([("2", "1", "ALIAS_OF", None, None, "nlp", 1), ("2", "3", "MET", None, None, "nlp", 2)], EDGE)
    r = case.ground_and_resolve(chunk, ent, edge, fuzzy=0.99)
    assert {x.id: x.canonical for x in r.id_map.collect()} == {"1": "1", "2": "1", "3": "3"}
    assert [(x.source_id, x.target_id, x.edge_type) for x in r.edge.collect()] == [("1", "3", "MET")]


def test_gold_notes(spark):
    note = "---\nentities:\n- {id: a, type: Firm, canonical: Acme}\n- {id: b, type: person}\nedges:\n- {from: a, type: employs, to: b, evidence: said}\n- {from: b, type: knows, to: zz}\n---\nbody"
    notes = spark.createDataFrame([("n1", note), ("n2", "---\nentities:\n- {id: a, type: other}\n---\n"), ("n3", "no front"), ("n4", "---\n: [broken\n---\n")], "path string, text string")
    ent, edge = gold.read_gold(notes, {"firm": "organization"}, {"EMPLOYS": "EMPLOYED_BY"}, ("EMPLOYS",))
    assert {(r.id, r.entity_type, r.label) for r in ent.collect()} == {("a", "organization", "Acme"), ("b", "person", "b"), ("zz", "unknown", "zz")}
    assert {(r.source_id, r.edge_type, r.target_id, r.source_url) for r in edge.collect()} == {("b", "EMPLOYED_BY", "a", "n1"), ("b", "KNOWS", "zz", "n1")}


def test_probabilistic_tier(spark):
    rows = [(f"a{i}", "person", f"name{i} last{i}") for i in range(30)] + [(f"b{i}", "person", f"name{i} last{i}x") for i in range(10)]
    ids = {r.id: r.canonical for r in Z.fellegi_sunter(spark.createDataFrame(rows, "id string, entity_type string, label string")).collect()}
    assert len(ids) == 40 and all(ids[f"a{i}"] == f"a{i}" for i in range(30))
    few = spark.createDataFrame(rows[:2], "id string, entity_type string, label string")
    assert {r.id: r.canonical for r in Z.fellegi_sunter(few).collect()} == {"a0": "a0", "a1": "a1"}


def test_embedding_failures_are_nulls(spark):
    def provider(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0, float(len(t))] for t in texts]

    df = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", None)], "id string, body string").coalesce(1)
    got = {r.id: r.embedding for r in S.embed(df, provider, batch=1).collect()}
    assert got == {"1": [1.0, 2.0], "2": None, "3": [1.0, 0.0]}
    assert S.vector(df.select("id", F.lit(None).cast("array<double>").alias("embedding")), [1.0]).count() == 0
