"""Cases with known answers, written as small frames."""

import json

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import evidence as V
from dossier.operators import extract as E
from dossier.operators import graph as G
from dossier.operators import ground as R
from dossier.operators import merge as M
from dossier.operators import quality as Q
from dossier.operators import resolve as Z
from dossier.operators import search as S
from dossier.operators import store as T
from dossier.plans.components import connected_components
from dossier.sources import files, ftm, tabular
from dossier.sources.ontology import Vocabulary

EDGE = "source_id string, target_id string, edge_type string, share_pct double, amount double, currency string"


def edges(spark, rows, kind="LINK"):
    return spark.createDataFrame([(a, b, kind, None, None, None) for a, b in rows], EDGE)


def own(spark, rows):
    return spark.createDataFrame([(a, b, "OWNS", s, None, None) for a, b, s in rows], EDGE)


def pay(spark, rows):
    return spark.createDataFrame([(a, b, "PAID_TO", None, x, c) for a, b, x, c in rows], EDGE)


def test_ownership_chain(spark):
    table = own(spark, [("P", "B", 100.0), ("B", "C", 55.0), ("D", "B", 30.0), ("Q", "B", None)])
    found, skipped = G.infer_control(table)
    assert [(r.source_id, r.target_id, r.effective_pct, r.hops) for r in found.collect()] == [("P", "C", 0.55, 2)]
    assert skipped.count() == 1
    low, _ = G.infer_control(table, threshold=0.10)
    assert {(r.source_id, r.effective_pct) for r in low.collect()} == {("P", 0.55), ("D", 0.165)}


def test_ownership_sums_paths_and_takes_largest_duplicate(spark):
    table = own(spark, [("A", "B", 50.0), ("A", "B", 20.0), ("A", "C", 60.0), ("B", "D", 100.0), ("C", "D", 100.0)])
    found = G.infer_control(table)[0].collect()
    assert [(r.target_id, r.effective_pct) for r in found] == [("D", 1.0)]


def test_ownership_percentages_round_as_printf_does(spark):
    table = own(spark, [(f"{x}{k}", f"{y}{k}", s) for k, p in enumerate((38.25, 44.55, 26.25, 38.35, 99.95)) for x, y, s in (("P", "B", 100.0), ("B", "C", p))])
    found = {r.source_id: r.evidence for r in G.infer_control(table)[0].collect()}
    assert found == {f"P{k}": f"P{k} -> B{k} -> C{k} = {p}%" for k, p in enumerate((38.2, 44.5, 26.2, 38.4, "100.0"))}
    shares = [0.0, 1e-9, 0.0005, 0.0015, 0.00049999, 0.999, 0.9995, 0.99949999, 1.0, *[k / 8000 for k in range(8001)], *[round(k / 7001, 9) for k in range(7002)]]
    got = spark.createDataFrame([(x,) for x in shares], "x double").select("x", X.percent(F.col("x")).alias("p")).collect()
    assert [r for r in got if r.p != f"{r.x * 100:.1f}%"] == []


def test_money(spark):
    chain = [("a", "b", 100_000.0, "USD"), ("b", "c", 90_000.0, "USD"), ("c", "d", 80_000.0, "USD"), ("a", "e", 5_000.0, "EUR")]
    start = spark.createDataFrame([("a",)], "id string")
    found = {tuple(r.path): r for r in G.trace_funds(pay(spark, chain), start).collect()}
    assert len(found) == 4 and all(r.currency != "MIXED" for r in found.values())
    assert found["a", "b", "c", "d"].bottleneck == 80_000
    assert G.max_flow(pay(spark, chain[:3]), "a", "d") == {"flow": 80_000.0, "currency": "USD"}
    assert G.max_flow(pay(spark, chain[:3]), "a", "zz")["flow"] == 0
    with pytest.raises(ValueError):
        G.max_flow(pay(spark, [*chain, ("e", "d", 1.0, "EUR")]), "a", "d")
    mixed = G.trace_funds(pay(spark, [("a", "b", 1.0, "USD"), ("b", "c", 1.0, "EUR")]), start).where("hops = 2").first()
    assert mixed.currency == "MIXED" and mixed.bottleneck is None


def test_money_ignores_cycles_and_negative_amounts(spark):
    found = G.trace_funds(pay(spark, [("a", "b", 1.0, "USD"), ("b", "a", 1.0, "USD"), ("a", "c", -5.0, "USD")]), spark.createDataFrame([("a",)], "id string"))
    assert [r.path for r in found.collect()] == [["a", "b"]]


MERGE = "source_id string, target_id string, edge_type string, amount_total double, contribution_count int, currency string, dates array<string>, share_pct double, ord long"


def test_merge_adds_up_donations(spark):
    rows = [("d1", "p", "FUNDED_BY", 2700.0, 4, "USD", ["a", "b", "c"], None, 1), ("d2", "p", "FUNDED_BY", 3950.0, 6, "USD", ["c", "d", "e"], None, 2)]
    moved = M.repoint(spark.createDataFrame(rows, MERGE), spark.createDataFrame([("d2", "d1")], "id string, canonical string"))
    written, review = M.plan(moved)
    r = written.first()
    assert (written.count(), r.amount_total, r.contribution_count, r.dates, r.currency) == (1, 6650.0, 10, ["a", "b", "c", "d", "e"], "USD")
    assert review.count() == 0


@pytest.mark.parametrize(("a", "b", "reason"), [(("USD", 1.0), ("CAD", 1.0), "currency_mismatch"), (("USD", 1.0), ("USD", 2.0), "non_additive_conflict:share_pct")])
def test_merge_sends_conflicts_to_review(spark, a, b, reason):
    rows = [("d", "p", "X", 1.0, 1, a[0], None, a[1], 1), ("d", "p", "X", 2.0, 1, b[0], None, b[1], 2)]
    written, review = M.plan(spark.createDataFrame(rows, MERGE))
    assert written.count() == 0 and {r.reason for r in review.collect()} == {reason} and review.count() == 2


def test_merge_keeps_one_of_identical(spark):
    rows = [("d", "p", "X", 5.0, 1, "", None, None, 1), ("d", "p", "X", 5.0, 1, "", None, None, 2)]
    written, _ = M.plan(spark.createDataFrame(rows, MERGE))
    assert [r.amount_total for r in written.collect()] == [5.0]


def test_grounding(spark):
    chunk = spark.createDataFrame([("c1", "Acme Corp met Jane Doe in Harbor City ($5,000)."), ("c2", "A scattered category.")], "id string, body string")
    ent = spark.createDataFrame([("e1", "Acme Corp"), ("e2", "Jane Doe"), ("e3", "cat"), ("e4", "$5,000"), ("e5", "J"), ("e6", "Jane")], "id string, label string")
    found = R.mentions(ent, chunk)
    assert {(r.entity, r.chunk) for r in found.collect()} == {("e1", "c1"), ("e2", "c1"), ("e4", "c1"), ("e6", "c1")}
    kept = R.ground_edges(edges(spark, [("e1", "e2"), ("e1", "e3")]), found)
    assert [(r.source_id, r.target_id) for r in kept.collect()] == [("e1", "e2")]


@pytest.mark.parametrize("source", [None, "", " ", "ghost", "file:///x", "DOC-1", "doc-1x", "/path", "path1 x"])
def test_gate_refuses_phantoms(spark, source):
    doc = spark.createDataFrame([("doc-1", "path1", "http://u"), ("doc-2", "", None)], "id string, path string, url string")
    e = spark.createDataFrame([("a", "b", source, "x", 1), ("a", "b", "http://u", "x", 2), ("a", "c", "", "doc-1", 3)], "source_id string, target_id string, source_url string, provenance string, ord long")
    good, bad = R.provenance_gate(e, doc)
    assert sorted(r.ord for r in good.collect()) == [2, 3] and [r.ord for r in bad.collect()] == [1]


def test_grade(spark):
    ent = spark.createDataFrame([("p", "person"), ("o", "organization")], "id string, entity_type string")
    e = edges(spark, [("p", "o"), ("o", "p")], "EMPLOYED_BY")
    good, bad = R.grade_gate(e, ent, Vocabulary.shipped().frame(spark))
    assert [(r.source_id, r.target_id) for r in good.collect()] == [("p", "o")] and bad.count() == 1


FIRMS = "id string, entity_type string, label string, reg_id string, address string, jurisdiction string"


@pytest.mark.parametrize(
    ("a", "b", "decision"),
    [
        (("Acme", "R1", "270 Park Ave", "US"), ("ACME Inc.", "r1", "270 Park Avenue.", "us "), "merge"),
        (("Acme", "R1", "270 Park Ave", "US"), ("Acme", "R1", "5th Ave", "US"), "review"),
        (("Acme", "R1", "270 Park Ave", "US"), ("Acme", "R1", None, "US"), "review"),
        (("Acme", "R1", "270 Park Ave", "US"), ("Acme", "R1", "270 Park Ave", "CA"), "review"),
        (("Acme", "R1", "270 Park Ave", "US"), ("Acme", "R2", "270 Park Ave", "US"), None),
        (("Acme", "​", "270 Park Ave", ""), ("Acme LLC", "---", "270 park avenue", ""), "merge"),
        (("Acme", "", "270 Park Ave #5", ""), ("Acme", "", "270 Park Ave Suite 5", ""), None),
        (("Summit", "", "1 A St", ""), ("Summit", "", "2 B St", ""), None),
    ],
)
def test_multifield(spark, a, b, decision):
    ent = spark.createDataFrame([("x", "organization", *a), ("y", "organization", *b)], FIRMS)
    ids, decided, _ = Z.multifield(ent)
    rows = decided.where("decision <> 'apart'").collect()
    assert [r.decision for r in rows] == ([decision] if decision else [])
    assert len({r.canonical for r in ids.collect()}) == (1 if decision == "merge" else 2)


@pytest.mark.parametrize(("a", "b", "score"), [("Acme 10", "Acme 0", 12 / 13), ("Acme 7", "Acme 7 LLC", 0.75), ("doe jane", "Jane Doe", 1.0)])
def test_token_sort_ratio(spark, a, b, score):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(Z.token_sort_ratio("a", "b")).first()[0]
    assert got == pytest.approx(score)


def test_fuzzy_pairs_lose_none(spark):
    import itertools
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(4, 40))).strip() or "x" for _ in range(60)]
    labels = base + [b[:3] + rng.choice("xyz") + b[4:] for b in base if len(b) > 6]
    ent = spark.createDataFrame([(f"{i:03}", "person", s) for i, s in enumerate(labels)], "id string, entity_type string, label string")
    got = {(r.a, r.b) for r in Z.fuzzy_pairs(ent, 0.85).collect()}
    key = lambda s: " ".join(sorted(s.lower().split()))
    first = {}
    for i, s in enumerate(labels):
        first.setdefault(key(s), f"{i:03}")

    def ratio(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j + 1], row[j])
        return 2 * row[-1] / (len(x) + len(y))

    want = {tuple(sorted((first[x], first[y]))) for x, y in itertools.combinations(first, 2) if ratio(x, y) >= 0.85}
    assert got == want


def test_greedy_is_not_transitive(spark):
    ent = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, ord long")
    pairs = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.95)], "a string, b string, score double")
    assert {r.id: r.canonical for r in Z.greedy(ent, pairs).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_alias_keeps_longest(spark):
    ent = spark.createDataFrame([("1", "person", "Jo"), ("2", "person", "Joanna"), ("3", "place", "Jo")], "id string, entity_type string, label string")
    ids = Z.alias(ent, edges(spark, [("1", "2"), ("2", "3")], "ALIAS_OF"))
    assert {r.id: r.canonical for r in ids.collect()} == {"1": "2", "2": "2", "3": "3"}


def test_blank_names_never_cluster(spark):
    ent = spark.createDataFrame([("1", "person", "!!", 1), ("2", "person", "??", 2), ("3", "person", "Иван", 3), ("4", "person", "Анна", 4)], "id string, entity_type string, label string, ord long")
    assert all(r.id == r.canonical for r in Z.by_name(ent).collect())


def test_semantic_verdict(spark):
    cases = [("claim", "person", 0.95, "exclude"), ("person", "person", 0.93, "review"), ("person", "person", 0.9985, "exclude"), ("person", "person", 1.0, "exclude"), ("person", "person", 0.90, "exclude"), ("Policy_Position", "x", 0.97, "exclude")]
    df = spark.createDataFrame([c[:3] for c in cases], "a string, b string, c double")
    assert [r[0] for r in df.select(X.semantic_verdict(F.col("a"), F.col("b"), F.col("c"))).collect()] == [c[3] for c in cases]


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(f"{i:04}", f"{i + 1:04}") for i in range(200)] + [("z0", f"z{i}") for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert all(got[x] == ("0000" if x[0] == "0" else "z0") for x in got) and len(got) == 251


def test_bridges_and_betweenness_of_known_graphs(spark):
    barbell = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")]
    assert [(r.u, r.v) for r in G.bridges(edges(spark, barbell)).collect()] == [("c", "d")]
    star = G.betweenness(edges(spark, [("h", x) for x in "abcd"]))
    assert {r.id: r.betweenness for r in star.collect()} == {"h": 1.0, "a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0}
    path = {r.id: r.betweenness for r in G.betweenness(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])).collect()}
    assert path["b"] == pytest.approx(2 / 3) and path["a"] == 0
    edge = {(r.u, r.v): r.betweenness for r in G.betweenness(edges(spark, [("a", "b"), ("b", "c")]), edges=True).collect()}
    assert edge["a", "b"] == pytest.approx(2 / 3)


def test_communities_and_gaps(spark):
    two = [(f"a{i}", f"a{j}") for i in range(6) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(6) for j in range(i)] + [("a0", "b0")]
    e = edges(spark, two)
    com = G.communities(e)
    assert len({r.community for r in com.collect()}) == 2
    assert G.modularity(com, e) > 0.4
    gap = G.gaps(com, e).collect()
    assert len(gap) == 1 and gap[0].cross_edges == 1 and gap[0].severity == "MEDIUM"


def test_homology_of_a_ring(spark):
    ring = G.homology(edges(spark, [(f"{i}", f"{(i + 1) % 6}") for i in range(6)]))
    assert ring["h1"] == [(1.0, 2.0)] and len(ring["h0"]) == 5
    tree = G.homology(edges(spark, [("a", "b"), ("a", "c"), ("c", "d")]))
    assert tree["h1"] == []


def test_order_of_input_does_not_matter(spark):
    rows = [(f"n{i}", f"n{(7 * i + 3) % 40}", "OWNS", float(30 + i % 60), None, None) for i in range(40)]
    a = G.infer_control(spark.createDataFrame(rows, EDGE))[0]
    b = G.infer_control(spark.createDataFrame(rows[::-1], EDGE).repartition(5))[0]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


SPEC = """
entities:
  - {column: owner, type_column: owner_type}
  - {column: asset, type_column: asset_type, attributes: {reg_id: reg}}
edges:
  - {source: owner, type: OWNS, target: asset, share_pct: pct, date: as_of}
"""


def test_tabular(spark, tmp_path):
    p = tmp_path / "own.csv"
    p.write_text('owner,owner_type,asset,asset_type,pct,as_of,reg\n"Doe, ""J""",person,B,company,100,2024-01-02,7\nB,organization,C,organization,"55%",,\nD,organization,B,organization,30,,7\nX,alien,C,organization,5,,\nE,event,C,organization,5,,\n')
    out = tabular.ingest(files.read_table_file(spark, str(p)), tabular.Spec.load(SPEC), "own.csv")
    labels = {r.label: r for r in out["entities"].collect()}
    assert set(labels) == {'Doe, "J"', "B", "C", "D", "E"} and labels["B"].reg_id == "7"
    assert sorted(r.share_pct for r in out["edges"].collect()) == [30.0, 55.0, 100.0]
    assert out["edges"].where("valid_at_ms = 1704153600000").count() == 1
    assert {r.reason for r in out["skipped"].collect()} == {"bad_entity_type", "grade_violation"}
    assert out["chunks"].count() == 5


@pytest.mark.parametrize("bad", ["entities: []", "entities: [{column: a}]", "entities: [{column: a, type: alien}]", "entities: [{column: a, type: person}]\nedges: [{source: a, type: OWNS, target: b}]",
    "entities: [{column: a, type: person}, {column: b, type: asset}]\nedges: [{source: a, type: OWNS, target: b, amount: x}]", "entities: [{column: a, type: event}, {column: b, type: asset}]\nedges: [{source: a, type: OWNS, target: b}]"])
def test_bad_specs_fail_early(bad):
    with pytest.raises(tabular.SpecError):
        tabular.Spec.load(bad)


def test_ftm_round_trip(spark):
    ent = spark.createDataFrame([("p", "person", "Jane"), ("o", "organization", "Acme"), ("c", "claim", "x"), ("d", "domain", "a.com")], "id string, entity_type string, label string")
    e = spark.createDataFrame([("p", "o", "OWNS", 55.0, None, None), ("o", "p", "FUNDED_BY", None, 10.0, "USD"), ("p", "o", "ASSOCIATED_WITH", None, None, None), ("c", "c", "CONTRADICTS", None, None, None)], EDGE)
    proxies, dropped = ftm.export(ent, e)
    assert {r.item for r in dropped.collect()} == {"c", "d", "c-CONTRADICTS->c"}
    ents, back, lost = ftm.load(proxies)
    assert {(r.id, r.entity_type) for r in ents.collect()} == {("p", "person"), ("o", "organization")} and lost.count() == 0
    assert {(r.edge_type, r.share_pct, r.amount, r.currency) for r in back.collect()} == {("OWNS", "55.0", None, None), ("FUNDED_BY", None, "10.0", "USD"), ("ASSOCIATED_WITH", None, None, None)}


def test_vocabulary_from_markdown(spark):
    md = "# x\n## Entity Types\n| Type | Description |\n|---|---|\n| Person | a human |\n## Edge Types\n| Type | From → To | Description |\n|---|---|---|\n| knows | person → any | d |\n| OCCURRED_ON | event → *(date)* | d |\n| BAD | person | d |\n"
    v = Vocabulary.parse(md)
    assert v.types == {"person": "a human"} and [tuple(r) for r in v.frame(spark).collect()] == [("KNOWS", "person", "*")] and len(v.warnings) == 1
    assert Vocabulary.shipped().legal("LOCATED_AT", "event", "location") and not Vocabulary.shipped().legal("OWNS", "event", "asset")


def test_evidence_gates(spark):
    man = spark.createDataFrame([("ab-1", "", "f1", "h1"), ("cd-2", "grp-9", "f2", "h2")], "artifact_id string, capture_group string, local_path string, sha256 string")
    rows = spark.createDataFrame([("L1", "ab-1", "VERIFIED"), ("L2", "grp-9", "GAP"), ("L3", "zz-8", "maybe"), ("L4", "(pending)", "UNVERIFIED")], "ledger_id string, artifact string, status string")
    fine = spark.createDataFrame([("f1", "h1"), ("f2", "other")], "local_path string, sha256 string")
    assert {(r.ledger_id, r.problem) for r in V.linkage_gate(rows, man, fine).collect()} == {("L2", "hash differs"), ("L3", "no artefact")}
    assert {r.ledger_id for r in V.ledger_gate(rows).collect()} == {"L3", "L4"}
    with pytest.raises(ValueError):
        V.minimise_gate(rows, [" "])


def test_payloads(spark):
    df = spark.createDataFrame([('{"entries": [1, 2]}',), ('{"entries": null, "total": 5}',), ("broken",)], "b string")
    assert [r[0] for r in df.select(V.breach_count(F.col("b"))).collect()] == [2, 5, 0]
    crt = spark.createDataFrame([(json.dumps([{"name_value": "A.com\n*.a.com"}, {"name_value": "b.a.com"}]),)], "b string")
    assert crt.select(V.crt_names(F.col("b"))).first()[0] == ["a.com", "b.a.com"]
    cdx = spark.createDataFrame([(json.dumps([["k", "timestamp"], ["x", "2020"], ["x", "2019"]]),)], "b string")
    assert tuple(cdx.select(V.cdx_span(F.col("b"))).first()[0]) == ("2019", "2020", 2)


def test_search_hides_what_is_confidential(spark):
    chunk = spark.createDataFrame([("1", "salmonella recall", "public", [1.0, 0.0]), ("2", "salmonella salmonella", "confidential", [1.0, 0.0]), ("3", "other", "public", [0.0, 1.0])], "id string, body string, sensitivity string, embedding array<double>")
    assert [r.id for r in S.bm25(chunk, "Salmonella").collect()] == ["1"]
    assert [r.id for r in S.hybrid(chunk, "salmonella", [1.0, 0.1]).collect()] == ["1", "3"]
    assert S.bm25(chunk, "the of").collect() == []
    assert [r.id for r in S.hybrid(chunk, "salmonella", None).collect()] == ["1"]


def test_extraction(spark):
    doc = spark.createDataFrame([("d", "On 2024-03-15 and March 5, 2024 paid $50,000.00 and $7; a@b.org. 2024-03-15")], "id string, text string")
    got = {(r.label, r.entity_type) for r in E.patterns(doc, email=True).collect()}
    assert got == {("2024-03-15", "event"), ("March 5, 2024", "event"), ("$50,000.00", "transaction"), ("$7", "transaction"), ("a@b.org", "contact")}
    chunk = spark.createDataFrame([("1", "x"), ("2", "boom")], "id string, body string").coalesce(1)

    def provider(body):
        if body == "boom":
            raise RuntimeError("down")
        return [{"source": "a", "target": "b", "type": "OWNS"}, {"source": " "}, "junk"]

    rows = E.relations(chunk, provider).collect()
    assert [(r.chunk_id, r.edge_type, r.error) for r in rows] == [("1", "OWNS", None), ("2", None, "down")]


def test_chunks_and_ids(spark):
    import uuid

    doc = spark.createDataFrame([("d", "p", "x" * 1700), ("e", "q", "  ")], "id string, path string, text string")
    rows = E.chunks(doc).orderBy("chunk_index").collect()
    assert [len(r.body) for r in rows] == [1000, 900, 100] and rows[1].id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "p:1"))


def test_quality_measures(spark):
    clusters = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 3, 2)], "id string, cluster int, gold int")
    r = Q.bcubed(clusters).first()
    assert r.precision == 1.0 and r.recall == pytest.approx((2 / 3 + 2 / 3 + 1 / 3 + 1) / 4)
    none = spark.createDataFrame([], "k int")
    assert tuple(Q.prf(none, none, ["k"]).first()) == (1.0, 1.0, 1.0)


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    got = T.upsert(old, spark.createDataFrame([("2", "c")], "id string, v string"))
    T.save({"t": got}, str(tmp_path / "g"))
    T.save({"t": got}, str(tmp_path / "g"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "g" / "t")).collect()} == {("1", "a"), ("2", "c")}
    ran = []
    assert T.migrate(1, 3, {1: lambda: ran.append(1), 2: lambda: ran.append(2)}) == 3 and ran == [1, 2]
    with pytest.raises(RuntimeError):
        T.migrate(1, 3, {2: lambda: None})


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("---\nt: 1\n---\nBody --- here")
    (tmp_path / "a" / "_skip.txt").write_text("x")
    (tmp_path / "p.html").write_text("<style>x</style><p>Hi &amp; <b>you</b></p>")
    (tmp_path / "x.bin").write_text("x")
    got = {r.title: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"n.md": "Body --- here", "p.html": "Hi & you"}
    assert [r.path.split("/")[-1] for r in files.listing(spark, str(tmp_path)).collect()] == ["n.md", "p.html"]
    assert files.route(["x/a.csv", "x/a.map.yaml", "x/b.csv"]) == {"x/a.csv": "x/a.map.yaml"}
    src = spark.createDataFrame([("s-1",), ("s-2",)], "id string")
    man = spark.createDataFrame([("s-1-page",), ("s-20",)], "artifact_id string")
    assert [r.id for r in files.pending_sources(src, man).collect()] == ["s-2"]


def test_streaming_replaces_documents(spark, tmp_path):
    from dossier.streaming import ingest

    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "1.json").write_text(json.dumps({"path": "a", "text": "one " * 400, "ingested_at": "2024-01-01T00:00:00"}) + "\n" + json.dumps({"path": "b", "text": "b", "ingested_at": "2024-01-01T00:00:00"}) + "\n")
    ingest.watch(spark, str(inbox), out, mark).awaitTermination()
    (inbox / "2.json").write_text(json.dumps({"path": "a", "text": "two", "ingested_at": "2024-01-02T00:00:00"}) + "\n")
    ingest.watch(spark, str(inbox), out, mark).awaitTermination()
    assert {(r.path, r.text) for r in ingest.current(spark, out, "document").collect()} == {("a", "two"), ("b", "b")}
    assert sorted(r.body for r in ingest.current(spark, out, "chunk").collect()) == ["b", "two"]
