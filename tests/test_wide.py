"""Methods for graphs of any size give what the methods for one task give; stems, views, schemas, tiers and floors."""

import random

import pytest
from pyspark.sql import functions as F

from dossier.functions.stem import stem
from dossier.operators import audit, evidence, extract, graph, resolve, search, store, view
from dossier.sources import processors


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(4)
    pairs = {(f"a{i}", f"a{rng.randrange(i)}") for i in range(1, 40)} | {(f"a{rng.randrange(40)}", f"a{rng.randrange(40)}") for _ in range(30)}
    pairs |= {(f"b{i}", f"b{i + 1}") for i in range(9)} | {("b0", "b5"), ("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("c0", "c0")}
    return spark.createDataFrame(sorted(pairs), "source_id string, target_id string").repartition(4)


@pytest.mark.parametrize("method", ["communities", "bridges", "betweenness", "edge betweenness", "pivots"])
def test_large_graphs_as_small_ones(edge, monkeypatch, method):
    run = {
        "communities": graph.communities, "bridges": graph.bridges, "betweenness": graph.betweenness, "edge betweenness": lambda e: graph.betweenness(e, edges=True), "pivots": lambda e: graph.betweenness(e, 9),
    }[method]
    want = sorted(map(tuple, run(edge).collect()))
    monkeypatch.setattr(graph, "COMPONENT_EDGES", 7)
    got = sorted(map(tuple, run(edge).collect()))
    assert want and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:-1] == b[:-1] and (a[-1] == b[-1] if isinstance(b[-1], str) else a[-1] == pytest.approx(b[-1], abs=2e-9))


def test_communities_raise_modularity(edge):
    com = graph.communities(edge)
    alone = com.withColumn("community", F.col("id"))
    assert graph.modularity(com, edge) > 0.4 > graph.modularity(alone, edge)


def test_stems():
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubling sized hopping falling hissing fizzed failing filing happy sky relational rational digitizer vietnamization hopefulness formality triplicate formative goodness revival adoption irritant bowdlerize probate rate cease controll roll by"
    stems = "caress poni ti cat feed agre plaster motor sing conflat troubl size hop fall hiss fizz fail file happi sky relat ration digit vietnam hope formal triplic form good reviv adopt irrit bowdler probat rate ceas control roll by"
    assert [stem(w) for w in words.split()] == stems.split()
    assert stem("x1s") == "x1s"


def test_search_modes(spark):
    rows = [("1", "licences reserved", "A licensed thing", "public", [1.0, 0.0]), ("2", "nothing here", "the licensing", "public", [0.0, 1.0]), ("3", "licensed", "x", "private", [1.0, 0.0]), ("4", "other", "words", "public", None)]
    chunk = spark.createDataFrame(rows, "id string, body string, title string, sensitivity string, embedding array<double>")
    ids = lambda **k: [r.id for r in search.search(chunk, "license", **k).collect()]
    assert sorted(ids(mode="fts")) == ["1", "2"] and ids(mode="semantic", vec=[1.0, 0.1]) == ["1", "2"]
    assert ids(mode="hybrid", vec=[1.0, 0.1])[0] in ("1", "2") and sorted(ids(mode="hybrid")) == ["1", "2"]
    assert [r.id for r in search.bm25(chunk, "licensing", stems=False).collect()] == ["2"]
    assert {(r.term, r.id, r.tf) for r in search.postings(chunk)[0].where("term = 'licens'").collect()} == {("licens", "1", 1), ("licens", "2", 1), ("licens", "3", 1)}
    with pytest.raises(ValueError):
        search.search(chunk, "x", "semantic")
    with pytest.raises(ValueError):
        search.search(chunk, "x", "other")


def test_view(spark):
    ent = spark.createDataFrame([("1", "person", "Ann 1999"), ("2", "event", "Fair of 2004-05-06"), ("3", "event", None)], "id string, entity_type string, label string")
    e = spark.createDataFrame([("1", "2", "ATTENDED"), ("1", "9", "ATTENDED")], "source_id string, target_id string, edge_type string")
    v = view.view(ent, e, [("Ann", "people"), ("A", "never")], [("n", "n"), ("199", "old")])
    assert {(r.id, r.year, r.domain, tuple(r.stories)) for r in v["nodes"].collect()} == {("1", 1999, "people", ("n", "old")), ("2", 2004, "other", ()), ("3", None, "other", ())}
    assert v["edges"].count() == 1 and [r.id for r in view.timeline(v["nodes"]).collect()] == ["1", "2"]
    assert {(r.what, r["name"], r.n) for r in v["tallies"].where("what = 'domain'").collect()} == {("domain", "people", 1), ("domain", "other", 2)}
    assert [r.truncated for r in view.limited(ent.select("id").orderBy("id"), 3).collect()] == [False] * 3


def test_schemas(spark, tmp_path):
    raw = spark.createDataFrame([("a", "b", "OWNS", None)], "source_id string, target_id string, edge_type string, confidence double")
    row = store.conform(raw, "edge").first()
    assert (row.confidence, row.provenance, row.amount) == (0.5, "unknown", None)
    with pytest.raises(ValueError):
        store.conform(raw.withColumn("tpye", F.lit(1)), "edge")
    assert store.create_tables(spark, f"file://{tmp_path}/t") == list(store.SCHEMAS) and store.create_tables(spark, f"file://{tmp_path}/t") == []


def test_tiers_from_clusters_and_adjudication(spark):
    ent = spark.createDataFrame([("x", 2), ("y", 1), ("z", 3), ("w", 4)], "id string, ord long")
    tier = resolve.cluster_tier(spark.createDataFrame([("x", "k"), ("y", "k"), ("gone", "k"), ("z", None)], "id string, cluster string"))
    assert {(r.id, r.canonical) for r in tier(ent).collect()} == {("x", "y"), ("y", "y"), ("z", "z"), ("w", "w")}
    pairs = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.9), ("b", "c", 0.88), ("c", "d", 0.5)], "a string, b string, score double")
    one, review = resolve.adjudicate(pairs, 0.92, lambda p: p.where("b = 'c' and a = 'a'"))
    assert {(r.a, r.b) for r in one.collect()} == {("a", "b"), ("a", "c")} and {(r.a, r.b) for r in review.collect()} == {("b", "c")}
    assert resolve.adjudicate(pairs, 0.92)[1].count() == 2


def test_processors(spark):
    reg = processors.Registry()
    made = lambda name, ok: processors.Processor(name, lambda p: ok, lambda s, p: {"entities": None, "edges": None, "text": spark.range(1)})
    assert reg.process(spark, "x")["text"] is None
    reg.register(made("a", True))
    reg.register(made("b", True), first=True)
    reg.register(made("c", False), first=True)
    assert reg.choose("x").name == "b"
    reg.register(made("b", False))
    assert reg.choose("x").name == "a"


def test_audit_precedence():
    assert audit.audit({"a": lambda: True})[1] == "PASS"
    assert audit.audit({"a": lambda: True, "b": lambda: None})[1] == "DEGRADED"
    rows, said = audit.audit({"a": lambda: None, "b": lambda: 1 / 0})
    assert said == "FAIL" and rows[1][2].startswith("ZeroDivisionError")


def test_providers_read_whole_texts_and_go_on(spark):
    docs = spark.createDataFrame([("d", "x" * 150_000 + " Acme")], "id string, text string")
    assert [r.label for r in extract.provided(docs, extract.gazetteer({"Acme": "organization"})).collect()] == ["Acme"]

    def often(body):
        if body != "ok":
            raise ValueError(body)
        return [{"source": "a", "target": "b", "type": "OWNS"}]

    chunk = spark.createDataFrame([(str(k), "bad" if k < 9 else "ok") for k in range(10)], "id string, body string").coalesce(1)
    got = extract.relations(chunk, often).collect()
    assert sum(r.error is not None for r in got) == 9 and [r.source for r in got if not r.error] == ["a"]


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 500).withColumn("k", F.xxhash64("id")).repartition(7)
    got = [r.k for r in evidence.numbered(df, "k").orderBy("ord").collect()]
    assert got == sorted(got) and [r.ord for r in evidence.numbered(df, "k").orderBy("ord").collect()] == list(range(1, 501))
