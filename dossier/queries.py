"""Every operator as a query over the shared tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import catalogue as C
from dossier.operators import cosines as N
from dossier.operators import evidence as V
from dossier.operators import extract as E
from dossier.operators import graph as G
from dossier.operators import ground as R
from dossier.operators import merge as M
from dossier.operators import quality as Q
from dossier.operators import resolve as Z
from dossier.operators import search as S
from dossier.operators import store as T
from dossier.operators import audit as A
from dossier.operators import view as W
from dossier.plans import case
from dossier.plans.casegraph import frame, oracle
from dossier.session import materialise, prepare, read_table, table_path
from dossier.sources import files, ftm, gold, processors, tabular
from dossier.sources.ontology import EDGES, TYPES, Vocabulary, canonical_edge, canonical_type, rejected_types, sides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Registers f(g) under a name; g('entity') is a table of the case graph, g.read('orders') a shared one."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(Graph(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = (oracle(*tables) if tables else "") + sql
        return f

    return add


class Graph:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """Rows as a VALUES table of another engine."""
    lit = lambda x: "null" if x is None else repr(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"


# --- catalogue -------------------------------------------------------------------------------

ENTITY_COLS = "id, label, entity_type, confidence, source_url"
query("q_entity_by_label", f"select {ENTITY_COLS} from entity where contains(label, 'Customer#00000') order by confidence desc, id limit 12", "entity")(lambda g: C.by_label(g("entity"), "Customer#00000"))
query("q_entity_by_type", "select id, label, confidence, source_url from entity where entity_type = 'location' order by label, id limit 12", "entity")(lambda g: C.by_type(g("entity"), "location"))
query("q_entity_by_label_and_type", f"select {ENTITY_COLS} from entity where contains(label, '00') and entity_type = 'organization' order by confidence desc, id limit 12", "entity")(lambda g: C.by_label(g("entity"), "00", "organization"))
query("q_all_entities", "select id, entity_type, label, confidence from entity", "entity")(lambda g: g("entity").select("id", "entity_type", "label", "confidence"))
query("q_all_edges", "select source_id, target_id, edge_type, e.confidence from edge e semi join entity a on a.id = source_id semi join entity b on b.id = target_id", "entity", "edge")(
    lambda g: C.joined(g("edge"), g("entity")).select("source_id", "target_id", "edge_type", "confidence")
)
_ENDS = "from edge e join entity a on a.id = e.source_id join entity b on b.id = e.target_id"
query("q_extracted_edges", f"select a.label src, edge_type, b.label tgt, e.provenance, e.confidence {_ENDS} where e.provenance is distinct from 'inferred'", "entity", "edge")(lambda g: C.extracted_edges(g("edge"), g("entity")))
query("q_inferred_edges", f"select a.label src, edge_type, b.label tgt, e.confidence, e.evidence {_ENDS} where e.provenance = 'inferred'", "entity", "edge")(lambda g: C.inferred_edges(g("edge"), g("entity")))
query("q_ownership_edges", "select source_id, target_id, share_pct from edge where edge_type = 'OWNS' and provenance is distinct from 'inferred'", "edge")(lambda g: C.ownership_edges(g("edge")))
query("q_money_edges", "select source_id, target_id, edge_type, amount, currency from edge where edge_type in ('FUNDED_BY', 'PAID_TO') and amount > 0", "edge")(lambda g: C.money_edges(g("edge")))
_CONTRA = f"select a.label claim_a, b.label claim_b, a.source_url source_a, b.source_url source_b, e.created_at found_at {_ENDS} where edge_type = 'CONTRADICTS' order by e.created_at desc, source_id, target_id limit 20"
query("q_contradictions", _CONTRA, "entity", "edge")(lambda g: C.contradictions(g("edge"), g("entity")))
query("ga_contra", _CONTRA, "entity", "edge")(lambda g: C.contradictions(g("edge"), g("entity"), 20))
query("q_new_since", "select entity_type, count(*) cnt from entity where created_at > 1700006000 group by 1", "entity")(lambda g: C.new_since(g("entity"), 1700006000))
_FREE = "id not in (select source_id from edge union select target_id from edge union select entity_id from mention)"
query("q_unlinked", f"select id, label, entity_type from entity where created_at < 1700050000 and {_FREE}", "entity", "edge", "mention")(lambda g: C.unlinked(g("entity"), g("edge"), g("mention"), 1700050000))
query("q_orphans", f"select id, label, entity_type from entity where {_FREE}", "entity", "edge", "mention")(lambda g: C.unlinked(g("entity"), g("edge"), g("mention")))
for _n in ("q_type_dist", "q_entity_type_dist"):
    query(_n, "select entity_type, count(*) cnt from entity group by 1", "entity")(lambda g: C.counted(g("entity"), "entity_type"))
query("q_edge_type_dist", "select edge_type, count(*) cnt from edge group by 1", "edge")(lambda g: C.counted(g("edge"), "edge_type"))


@query("q_counts", "select 'entity' what, count(*) cnt from entity union all select 'edge', count(*) from edge union all select 'document', count(*) from document", "entity", "edge", "document")
def _(g):
    one = lambda t: g(t).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(t).alias("what"), "cnt")
    return one("entity").union(one("edge")).union(one("document"))


query("q_llm_entities", "select id, label, entity_type, trust_penalty from entity where extraction_source = 'llm'", "entity")(lambda g: C.from_llm(g("entity")).select("id", "label", "entity_type", "trust_penalty"))
query("q_llm_edges", "select count(*) cnt from edge where extraction_source = 'llm'", "edge")(lambda g: C.from_llm(g("edge")).agg(F.count(F.lit(1)).alias("cnt")))
query("q_low_conf", "select id, label, entity_type, confidence from entity where confidence < 0.6e0", "entity")(lambda g: C.low_confidence(g("entity")))
query("q_needs_review", "select id, label, entity_type, created_at from entity where quality_flag = 'needs_review'", "entity")(lambda g: C.needs_review(g("entity")))
query("q_junk", r"select id, label from entity where entity_type = 'concept' and (label like '%Session%' or label like '%Commit%' or label like '%File%' or regexp_matches(label, '\d{4}-\d{2}-\d{2}'))", "entity")(lambda g: C.junk(g("entity")))
query("q_point_in_time", "select source_id, target_id, edge_type, created_at from edge where created_at <= 1700001200 and (case when edge_type = 'OWNS' then created_at + 600 else 0 end = 0 or created_at + 600 > 1700001200)", "edge")(
    lambda g: C.at(g("edge").withColumn("expired_at", F.when(F.col("edge_type") == "OWNS", F.col("created_at") + 600).otherwise(F.lit(0))), 1700001200).select("source_id", "target_id", "edge_type", "created_at")
)
query("q_query", "select id, label from entity where entity_type = 'location' and confidence >= 0.9e0", "entity")(
    lambda g: T.query(g.spark, "select id, label from {entity} where entity_type = :kind and confidence >= :least".replace("{entity}", "case_entity"), {"kind": "location", "least": 0.9}, case_entity=g("entity"))
)
query("src_graph_scan", "select id, label, entity_type, provenance, extraction_source from entity", "entity")(lambda g: g("entity").select("id", "label", "entity_type", "provenance", "extraction_source"))

# --- sources and sinks -----------------------------------------------------------------------

query("src_chunks_for_docs", "select id, doc, chunk_index, body from chunk where doc_id in (3, 7, 11)", "document", "chunk")(
    lambda g: g("chunk").join(F.broadcast(g.values([(3,), (7,), (11,)], "doc_id long")), "doc_id", "left_semi").select("id", "doc", "chunk_index", "body")
)
query("src_frontmatter", "select id, md5(case when doc_id % 2 = 0 then '\n' || text else text end) h from document", "document")(
    lambda g: g("document").select("id", F.md5(files.strip_frontmatter(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ntitle: x\n---\n\n"), "text")).otherwise(F.col("text")))).alias("h"))
)
query("src_text", r"""select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) h from pages""")(
    lambda g: g.read("pages").select("page_id", F.md5(files.strip_html(F.col("html"))).alias("h"))
)
query("src_sources", "select id from (select concat('a-', p_partkey) id from part) s where id not in (select concat('a-', p_partkey) from part where p_size < 10)")(
    lambda g: files.pending_sources(g.read("part").select(F.concat(F.lit("a-"), F.col("p_partkey").cast("string")).alias("id")), g.read("part").where("p_size < 10").select(F.concat(F.lit("a-"), F.col("p_partkey").cast("string"), F.lit("-page1")).alias("artifact_id")))
)
query("snk_chunks", "select p_partkey id, p_name body, 2 batch from part where p_partkey % 3 = 0 union all select p_partkey, p_type, 1 from part where p_partkey % 3 <> 0")(
    lambda g: T.latest(g.read("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("body"), F.lit(1).alias("batch")).union(g.read("part").where("p_partkey % 3 = 0").select("p_partkey", "p_name", F.lit(2))))
)
query("snk_upsert", "select c_custkey id, c_name v from customer where c_custkey >= 5 union all select n_nationkey, n_name from nation where n_nationkey < 5")(
    lambda g: T.upsert(g.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v")), g.read("nation").where("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("v")))
)
query("snk_doc_delete", "select id, doc from chunk where doc_id % 4 <> 0", "document", "chunk")(
    lambda g: T.delete_documents(g("chunk").withColumn("k", F.col("doc")), g("document").where("doc_id % 4 = 0").select("id"), "doc").select("id", "doc")
)
query("snk_entities", "select id, coalesce(case when p % 3 = 0 then null else 0.7e0 end, 0.5e0) confidence, case when p % 2 = 0 then 'unknown' else 'table' end provenance, case when p % 2 = 0 then 'unknown' else 'table' end extraction_source from (select concat('p', p_partkey) id, p_partkey p from part)")(
    lambda g: T.with_defaults(g.read("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 3 != 0, 0.7).alias("confidence"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("table").alias("provenance"), F.lit("").alias("extraction_source")))
)
query("snk_link", "select o_custkey chunk, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) entity_ids from orders group by 1")(
    lambda g: T.link_entities(g.read("orders").select(F.col("o_custkey").alias("chunk"), F.col("o_orderpriority").alias("entity"))).select("chunk", F.array_join("entity_ids", ",").alias("entity_ids"))
)
query("snk_graph", "select (select count(distinct id) from entity) entities, (select count(*) from edge where source_url in (select path from document union select id from document) and source_id in (select id from entity) and target_id in (select id from entity)) edges, (select count(*) from edge where source_url not in (select path from document union select id from document)) edges_rejected, (select count(*) from document) documents, (select count(*) from mention) mentions", "entity", "edge", "document", "mention")(
    lambda g: T.build(g("entity"), V.numbered(g("edge").drop("ord"), "edge_type", "source_id", "target_id"), g("document").select("id", "path"), g("mention"))[1]
)
query("snk_graph_nodes", "select id, min(label) label from entity group by 1", "entity")(lambda g: M.first_seen(g("entity").unionByName(g("entity").withColumn("label", F.concat(F.lit("~"), "label"))), ["id"], "label").select("id", "label"))
query("snk_ftm_out", """select edge_type || ':' || source_id || ':' || target_id item, 'proxy' what from edge where edge_type = 'OWNS'
    union all select id, 'proxy' from entity where entity_type in ('person', 'organization', 'location', 'asset')
    union all select id, 'dropped' from entity where entity_type in ('claim', 'concept') union all select source_id || '-' || edge_type || '->' || target_id, 'dropped' from edge where edge_type <> 'OWNS'""", "entity", "edge")(
    lambda g: (lambda pd: pd[0].select(F.col("id").alias("item"), F.lit("proxy").alias("what")).union(pd[1].select("item", F.lit("dropped"))))(ftm.export(g("entity"), g("edge")))
)
query("src_ftm_in", "select source_id, target_id, edge_type, share_pct::varchar share_pct from edge where edge_type = 'OWNS'", "edge")(lambda g: ftm.load(ftm.export(g("entity"), g("edge"))[0])[1].where("edge_type = 'OWNS'").select("source_id", "target_id", "edge_type", "share_pct"))
query("snk_stats", "select sensitivity, count(*) total, count(*) filter (chunk_index % 2 = 0) embedded, count(*) filter (chunk_index % 2 = 1) unembedded from chunk group by 1", "document", "chunk")(
    lambda g: T.stats(g("chunk").withColumn("embedding", F.when(F.col("chunk_index") % 2 == 0, F.array(F.lit(1.0)))))
)
_DOMAINS, _STORIES = [("^Supplier", "supplier"), ("^Customer", "customer")], [("1$", "one"), ("00", "zeros")]
query("snk_viz", """, t as (select case when label like 'Supplier%' then 'supplier' when label like 'Customer%' then 'customer' else 'other' end d, entity_type, label from entity)
    select 'domain' what, d as name, count(*) n from t group by d union all select 'type', entity_type, count(*) from t group by entity_type union all select 'story', 'one', count(*) from t where label like '%1' having count(*) > 0 union all select 'story', 'zeros', count(*) from t where label like '%00%' having count(*) > 0
    union all select 'edges', edge_type, count(*) from edge where source_id in (select id from entity) and target_id in (select id from entity) group by edge_type""", "entity", "edge")(
    lambda g: (lambda v: v["tallies"].union(v["edges"].groupBy(F.lit("edges").alias("what"), F.col("edge_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))))(W.view(g("entity"), g("edge"), _DOMAINS, _STORIES))
)
# --- scalar functions ------------------------------------------------------------------------

query("f_chunk", "select id, chunk_index, md5(body) h from chunk", "document", "chunk")(lambda g: g("chunk").select("id", "chunk_index", F.md5("body").alias("h")))
query("f_chunk_id", "select id, doc, chunk_index from chunk", "document", "chunk")(lambda g: g("chunk").select("id", "doc", "chunk_index"))
query("f_entity_id", "select id, substr(sha256(entity_type || ':' || lower(trim(label)) || ':' || source_url), 1, 16) h from entity", "entity")(lambda g: g("entity").select("id", X.entity_id(F.col("label"), F.col("entity_type"), F.col("source_url")).alias("h")))
query("f_norm", r"select doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) h from documents")(lambda g: g.read("documents").select("doc_id", F.md5(X.norm(F.col("text"))).alias("h")))
query("f_label_in_text", r"select doc_id, regexp_matches(lower(text), '(^|[^\pL\pN_])the([^\pL\pN_]|$)') hit from documents")(lambda g: g.read("documents").select("doc_id", X.whole_word(F.lit("the"), F.lower("text")).alias("hit")))

NAMES = [(1, "Acme Corp."), (2, "ACME, L.L.C."), (3, "Smith & Sons Ltd"), (4, "Apex Holdings Ltd"), (5, "X B.V."), (6, "Inc"), (7, "J P Morgan"), (8, "Foo S.A.S. Co"), (9, "Müller GmbH"), (10, ""), (11, "Acme 7 LLC"), (12, "Bar and Company Inc.")]
_KEYS = {1: "acme", 2: "acme", 3: "smith", 4: "apex holdings", 5: "x", 6: "inc", 7: "j p morgan", 8: "foo", 9: "muller", 10: None, 11: "acme 7", 12: "bar"}
query("f_norm_name", f"select v.id::bigint id, case v.id {' '.join(f'''when {k} then {'null' if w is None else repr(w)}''' for k, w in _KEYS.items())} end k from {values(NAMES, 'id, name')}")(lambda g: g.values(NAMES, "id long, name string").select("id", X.norm_name(F.col("name")).alias("k")))
query("f_depunct", "select p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_type), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) k from part")(lambda g: g.read("part").select("p_partkey", X.depunct(F.concat("p_name", F.lit(" & "), "p_type")).alias("k")))
ADDRESSES = [(1, "270 Park Ave."), (2, "270 park avenue"), (3, "270 Park Ave #5"), (4, " 12  N Main St, Ste 400 "), (5, "#"), (6, None), (7, "5th Avenue NW")]
_FULL = {1: "270 park avenue", 2: "270 park avenue", 3: "270 park avenue 5", 4: "12 north main street suite 400", 5: "", 6: "", 7: "5th avenue northwest"}
query("f_norm_address", f"select v.id::bigint id, case v.id {' '.join(f'when {k} then {w!r}' for k, w in _FULL.items())} end k from {values(ADDRESSES, 'id, a')}")(lambda g: g.values(ADDRESSES, "id long, a string").select("id", X.norm_address(F.col("a")).alias("k")))
query("f_strip_unicode", "select p_partkey, replace(p_name, ' ', '') k from part")(lambda g: g.read("part").select("p_partkey", X.strip_unicode(F.concat(F.col("p_name"), F.lit("​ "))).alias("k")))
query("f_norm_field", "select p_partkey, lower(p_name || ' x') k from part")(lambda g: g.read("part").select("p_partkey", X.norm_field(F.concat(F.lit("  "), F.upper("p_name"), F.lit("​  X "))).alias("k")))
query("f_norm_reg", "select p_partkey, case when p_partkey % 3 = 0 then null else lower(p_brand) end k from part")(lambda g: g.read("part").select("p_partkey", X.norm_reg(F.when(F.col("p_partkey") % 3 == 0, "---").otherwise(F.col("p_brand"))).alias("k")))
query("f_verdict", """with p as (select a.vec_id a, b.vec_id b, a.label ta, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id)
    select a, b, case when ta = 3 then 'exclude' when round(c, 6) >= 0.45e0 then 'exclude' when round(c, 6) >= 0.2e0 then 'review' else 'exclude' end verdict from p""")(
    lambda g: N.cosines(g.read("embeddings"), "label", "vec_id", "embedding", with_key=True).select(
        "a", "b", X.semantic_verdict(F.when(F.col("key") == 3, "claim").otherwise("person"), F.lit("person"), F.col("cosine"), 0.2, 0.45).alias("verdict"))
)
query("f_verdict_bool", "select entity_type, false merges from entity group by 1", "entity")(lambda g: g("entity").select("entity_type", (~X.semantic_verdict(F.col("entity_type"), F.lit("person"), F.lit(0.95)).isin("exclude", "review")).alias("merges")).distinct())
query("f_stance", "select distinct entity_type, entity_type = 'claim' stance from entity", "entity")(lambda g: g("entity").select("entity_type", X.stance_bearing(F.col("entity_type")).alias("stance")).distinct())
_SENT = "'On ' || strftime(o_orderdate, '%Y-%m-%d') || ' paid $' || o_custkey || ',000.50 to x; see January 5, 2024.'"
_SENTS = lambda g: g.read("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("On "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" paid $"), F.col("o_custkey").cast("string"), F.lit(",000.50 to x; see January 5, 2024.")).alias("text"))
query("f_date_extract", f"select id, unnest(regexp_extract_all(text, '{X.DATE}')) d from (select o_orderkey id, {_SENT} as text from orders)")(lambda g: _SENTS(g).select("id", F.explode(F.regexp_extract_all("text", F.lit(f"({X.DATE})"))).alias("d")))
query("f_money_extract", rf"select id, unnest(regexp_extract_all(text, '{X.MONEY}')) d from (select o_orderkey id, {_SENT} as text from orders)")(lambda g: _SENTS(g).select("id", F.explode(F.regexp_extract_all("text", F.lit(f"({X.MONEY})"))).alias("d")))
query("x_phase1", rf"""with t as (select o_orderkey id, {_SENT} as text from orders)
    select distinct id doc_id, label, 'event' entity_type, 0.9e0 confidence from (select id, unnest(regexp_extract_all(text, '{X.DATE}')) as label from t) union all
    select distinct id, label, 'transaction', 0.85e0 from (select id, unnest(regexp_extract_all(text, '{X.MONEY}')) as label from t)""")(lambda g: E.patterns(_SENTS(g)).select("doc_id", "label", "entity_type", "confidence"))
query("x_confidence", rf"""with t as (select o_orderkey id, {_SENT} as text from orders) select confidence, count(*) n from (select 0.9e0 confidence from (select distinct id, unnest(regexp_extract_all(text, '{X.DATE}')) from t) union all
    select 0.85e0 from (select distinct id, unnest(regexp_extract_all(text, '{X.MONEY}')) from t)) group by 1""")(lambda g: E.patterns(_SENTS(g)).groupBy("confidence").agg(F.count(F.lit(1)).alias("n")))
NUMBERS = [(1, "55"), (2, "55%"), (3, "50,000"), (4, "nan"), (5, ""), (6, " 7.5 "), (7, "x"), (8, None), (9, "-3")]
query("f_to_float", f"select v.id::bigint id, case v.id when 1 then 55.0e0 when 2 then 55.0e0 when 3 then 50000.0e0 when 6 then 7.5e0 when 9 then -3.0e0 end d from {values(NUMBERS, 'id, s')}")(lambda g: g.values(NUMBERS, "id long, s string").select("id", X.to_double(F.col("s")).alias("d")))
query("f_share", f"select v.id::bigint id, case v.id when 1 then 0.55e0 when 2 then 0.55e0 when 3 then 500.0e0 when 6 then 0.075e0 when 9 then -0.03e0 end d from {values(NUMBERS, 'id, s')}")(lambda g: g.values(NUMBERS, "id long, s string").select("id", X.share(F.col("s")).alias("d")))
query("f_iso_ms", "select o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) ms from orders")(lambda g: g.read("orders").select("o_orderkey", X.iso_millis(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ms")))
query("f_row_text", "select p_partkey, 'name=' || p_name || ', size=' || p_size t from part")(lambda g: g.read("part").select("p_partkey", X.row_text(name=F.col("p_name"), blank=F.lit("  "), size=F.col("p_size")).alias("t")))
query("f_cosine", "select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) c from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id")(
    lambda g: N.cosines(g.read("embeddings"), "label", "vec_id", "embedding").withColumnRenamed("cosine", "c")
)
query("f_json", "select event_id, (props->>'k')::bigint k from events")(lambda g: g.read("events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k")))
query("f_slug", "select p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') s from part")(lambda g: g.read("part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("s")))
query("f_selector", "select c_custkey, 'email' field, c_name || '@x' as value from customer")(lambda g: g.read("customer").select("c_custkey", V.selector(F.concat(F.lit("Email: "), "c_name", F.lit("@x"))).alias("s")).select("c_custkey", "s.field", "s.value"))
query("f_token", "select c_custkey, 'ab-' || c_custkey t from customer")(lambda g: g.read("customer").select("c_custkey", F.explode(V.tokens(F.concat(F.lit("see ab-"), F.col("c_custkey").cast("string"), F.lit(" (pending)")))).alias("t")))
STATES = [(1, "**VERIFIED**"), (2, "UNSUPPORTED as stated (x)"), (3, "DOWNGRADED → DRAFT-ONLY"), (4, "Inferred, not documented"), (5, "maybe"), (6, "CAPTURED/grounded"), (7, "VERIFIEDISH")]
query("f_status", f"select v.id::bigint id, case v.id when 1 then 'VERIFIED' when 2 then 'UNSUPPORTED' when 3 then 'DOWNGRADED' when 4 then 'INFERRED' when 6 then 'CAPTURED' else '' end s from {values(STATES, 'id, s')}")(lambda g: g.values(STATES, "id long, s string").select("id", X.status(F.col("s")).alias("s")))
query("agg_status", f"select case v.id when 1 then 'VERIFIED' when 2 then 'UNSUPPORTED' when 3 then 'DOWNGRADED' when 4 then 'INFERRED' when 6 then 'CAPTURED' else '' end status, count(*) n from {values(STATES, 'id, s')} group by 1")(lambda g: V.status_counts(g.values(STATES, "id long, status string")))
REPORT = "# x\n| ID | Finding | Origin | Status | Source | Artifact |\n|---|---|---|---|---|---|\n| L1 | a | b | VERIFIED | u | ab-1 |\n| short | row |\n| L2 | c | d | GAP | v | none |\n\n| L3 | x | y | GAP | z | after |\n"
query("f_md_table", "select 'r' doc, * from (values ('L1', 'a', 'VERIFIED', 'ab-1'), ('L2', 'c', 'GAP', 'none')) v(ledger_id, finding, status, artifact)")(lambda g: V.ledger(g.values([("r", REPORT)], "doc string, text string")).select("doc", "ledger_id", "finding", "status", "artifact"))
query("f_year", "select o_orderkey, year(o_orderdate)::varchar y from orders")(lambda g: g.read("orders").select("o_orderkey", X.year(F.concat(F.lit("filed in "), F.date_format("o_orderdate", "yyyy-MM"))).alias("y")))
query("f_domain", "select p_partkey, case when p_type like '%BRASS%' then 'brass' when p_size > 25 then 'big' else 'other' end d from part")(lambda g: g.read("part").select("p_partkey", X.first_rule(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")), [("BRASS", "brass"), (" (2[6-9]|[3-9][0-9])$", "big")], "other").alias("d")))
query("f_story", "select p_partkey, concat_ws(',', case when p_size > 25 then 'big' end, case when p_size % 2 = 0 then 'even' end) d from part")(lambda g: g.read("part").select("p_partkey", F.array_join(X.all_rules(F.col("p_size").cast("string"), [("^(2[6-9]|[3-9][0-9])$", "big"), ("[02468]$", "even")]), ",").alias("d")))
query("f_alias_norm", "select * from (values ('company', 'organization'), ('Person', 'person'), ('filing', 'document')) v(raw, kind)")(lambda g: g.values([("company",), ("Person",), ("filing",)], "raw string").select("raw", canonical_type(F.col("raw")).alias("kind")))
query("f_edge_alias", "select * from (values ('works_for', 'EMPLOYED_BY'), ('OWNS', 'OWNS'), ('DIRECTOR_OF', 'BOARD_MEMBER_OF')) v(raw, kind)")(lambda g: g.values([("works_for",), ("OWNS",), ("DIRECTOR_OF",)], "raw string").select("raw", canonical_edge(F.col("raw")).alias("kind")))
query("f_hash", "select doc_id, sha256(text) h from documents")(lambda g: g.read("documents").select("doc_id", F.sha2("text", 256).alias("h")))
query("f_snippet", "select doc_id, md5(case when length(text) > 200 then substr(replace(text, chr(10), ' '), 1, 200) || '...' else replace(text, chr(10), ' ') end) h from documents")(lambda g: g.read("documents").select("doc_id", F.md5(X.snippet(F.col("text"))).alias("h")))
query("f_claims", "select id, line_no, md5(line) h from (select id, unnest(string_split(text, chr(10))) line, unnest(range(1, len(string_split(text, chr(10))) + 1))::int line_no from document) where regexp_matches(line, 'License') and not regexp_matches(line, 'MIT')", "document")(
    lambda g: V.claims(g("document"), "License", "MIT").select("id", "line_no", F.md5("line").alias("h"))
)
query("f_split_options", "select * from (values ('person/organization', 'person,organization'), ('any', '*'), ('', '*'), (' Person /  ', 'person'), ('person/any', '*')) v(raw, o)")(lambda g: g.values([("person/organization",), ("any",), ("",), (" Person /  ",), ("person/any",)], "raw string").select("raw", F.array_join(sides(F.col("raw")), ",").alias("o")))
query("f_cluster_key", "select id, entity_type || '|' || lower(replace(label, '#', ' ')) k from entity where entity_type = 'organization'", "entity")(lambda g: g("entity").where("entity_type = 'organization'").select("id", X.cluster_key(F.col("entity_type"), F.col("label")).alias("k")))
query("f_edge_key", "select source_id || '|' || target_id || '|' || edge_type k, count(*) n from edge group by 1", "edge")(lambda g: M.edge_key(g("edge")).groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")))
query("f_data_props", """select source_id, target_id, edge_type, 'amount' prop, '{"amount":' || amount || '}' v from edge where amount is not null union all select source_id, target_id, edge_type, 'currency', '{"currency":"' || currency || '"}' from edge where currency is not null
    union all select source_id, target_id, edge_type, 'share_pct', '{"share_pct":' || share_pct || '}' from edge where share_pct is not null""", "edge")(lambda g: M.data_props(g("edge")).select(*M.KEY, F.explode("data").alias("prop", "v")))
query("p_structured", "select id from entity where extraction_source = 'structured'", "entity")(lambda g: Z.structured(g("entity")).select("id"))
query("p_multifield", "select s_suppkey from supplier where s_suppkey % 2 = 0")(lambda g: (lambda f: f.where(Z.has_fields(f)).select("s_suppkey"))(g.read("supplier").withColumns({"reg_id": F.when(F.col("s_suppkey") % 4 == 0, "7").otherwise("\u200b "), "address": F.when(F.col("s_suppkey") % 4 == 2, "1 A St")})))
ONTO = """
## Entity types
| Type | Meaning |
|-|-|
| `person` | a human being |
| `firm` | a company |

## Edge types
| Type | From -> To | Meaning |
|-|-|-|
| KNOWS | person -> any | acquaintance |
| **RUNS** | person / firm -> firm | control |
| LOST | nowhere | no arrow |
"""
query("f_prompt", "select * from (values (1, '- person: a human being'), (2, '- firm: a company'), (3, '- KNOWS: person -> any. acquaintance'), (4, '- RUNS: person / firm -> firm. control')) v(n, line)")(lambda g: g.values(list(enumerate(Vocabulary.parse(ONTO).prompt().split("\n"), 1)), "n int, line string"))
# --- joins, grounding, gates -----------------------------------------------------------------

LABELS = [("e1", "the"), ("e2", "of the"), ("e3", "Apache License"), ("e4", "x"), ("e5", "All rights reserved"), ("e6", "ungh"), ("e7", "CC BY-NC 4.0")]
_GROUND = rf"""{oracle('document', 'chunk')}, l as (select id e, lower(label) lab from {values(LABELS, 'id, label')}), c as (select id, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) body from chunk),
    found as (select e entity, id chunk from l join c on length(lab) >= 2 and regexp_matches(body, '(^|[^\pL\pN_])' || replace(lab, '.', '\.') || '([^\pL\pN_]|$)'))"""
_found = lambda g: R.mentions(g.values(LABELS, "id string, label string"), g("chunk"))
query("j_ground_entity", _GROUND + " select entity, chunk from found")(_found)
PAIRS = [("e1", "e2", "X"), ("e1", "e3", "X"), ("e3", "e5", "X"), ("e4", "e1", "X")]
query("j_ground_edge", _GROUND + f" select v.source_id, v.target_id from {values(PAIRS, 'source_id, target_id, edge_type')} where exists (select 1 from found a join found b using (chunk) where a.entity = source_id and b.entity = target_id)")(
    lambda g: R.ground_edges(g.values(PAIRS, "source_id string, target_id string, edge_type string"), _found(g)).select("source_id", "target_id")
)
query("g_ground", _GROUND + f" select id from {values(LABELS, 'id, label')} where id in (select entity from found)")(lambda g: R.ground_entities(g.values(LABELS, "id string, label string"), _found(g)).select("id"))
query("agg_quarantine", _GROUND + f" select 'entity' kind, 7::bigint total, 7 - count(distinct entity) quarantined, round((7 - count(distinct entity)) / 7.0e0, 6) rate from found")(
    lambda g: Q.quarantine(g.values(LABELS, "id string, label string"), R.ground_entities(g.values(LABELS, "id string, label string"), _found(g)), ["id"], "entity")
)
_RESCUE = "k as (select *, replace(lower(label), '#', ' ') n from entity where entity_type = 'organization'), h as (select * from k where id like '%0' or id like '%1')"
_twins = lambda g: (lambda e: e.unionByName(e.withColumns({"id": F.concat(F.lit("x"), "id"), "label": F.concat("label", F.lit(" LLC"))})))(g("entity").where("entity_type = 'organization'"))
query("g_rescue_entity", f", {_RESCUE} select 'x' || id id from h", "entity")(lambda g: R.rescue_entities(_twins(g), g("entity").where("entity_type = 'organization' and (id like '%0' or id like '%1')")).where("id like 'x%'").select("id"))
query("g_rescue_edge", "select source_id, target_id from edge where extraction_source = 'structured' and source_id like 's%' and target_id like 's%'", "edge")(lambda g: R.rescue_edges(g("edge"), g("entity").where("id like 's%'")).select("source_id", "target_id"))
_LOC = "(select id from document union select path from document)"
query("j_gate", f"select source_id, target_id, edge_type from edge where source_url in {_LOC}", "document", "edge")(lambda g: R.provenance_gate(V.numbered(g("edge").drop("ord"), "edge_type", "source_id", "target_id"), g("document"))[0].select("source_id", "target_id", "edge_type"))
query("gt_prov", f"select count(*) filter (source_url in {_LOC}) admitted, count(*) filter (source_url not in {_LOC}) rejected from edge", "document", "edge")(
    lambda g: (lambda x: x[0].agg(F.count(F.lit(1)).alias("admitted")).join(x[1].agg(F.count(F.lit(1)).alias("rejected"))))(R.provenance_gate(V.numbered(g("edge").drop("ord"), "edge_type", "source_id", "target_id"), g("document")))
)
_LEGAL = "(edge_type = 'LOCATED_AT' or (edge_type = 'OWNS' and a.entity_type in ('person', 'organization') and b.entity_type in ('asset', 'organization')) or (edge_type = 'CONTRADICTS' and a.entity_type = 'claim'))"
query("j_grade", f"select source_id, target_id, edge_type {_ENDS} where {_LEGAL}", "entity", "edge")(lambda g: R.grade_gate(g("edge"), g("entity"), Vocabulary.shipped().frame(g.spark))[0].select("source_id", "target_id", "edge_type"))
query("gt_grade", f"select edge_type, count(*) n {_ENDS} where not {_LEGAL} group by 1", "entity", "edge")(lambda g: R.grade_gate(g("edge"), g("entity"), Vocabulary.shipped().frame(g.spark))[1].groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")))
query("gt_type", "select entity_type, count(*) cnt from entity where entity_type = 'concept' group by 1", "entity")(lambda g: rejected_types(g("entity"), TYPES))
query("agg_rejections", "select entity_type, count(*) cnt from entity where entity_type = 'concept' group by 1", "entity")(lambda g: rejected_types(g("entity"), TYPES))
query("set_diff", "select unnest(['person', 'organization', 'document', 'transaction', 'location', 'event', 'asset', 'claim', 'domain']) entity_type except select entity_type from entity", "entity")(lambda g: g.values([(t,) for t in TYPES], "entity_type string").subtract(g("entity").select("entity_type")))
query("set_intersect", "select n_regionkey k from nation intersect select n_nationkey from nation where n_nationkey > 1")(lambda g: g.read("nation").select(F.col("n_regionkey").alias("k")).intersect(g.read("nation").where("n_nationkey > 1").select("n_nationkey")))
query("set_union_ids", "select o_custkey id from orders where o_orderstatus = 'F' union select c_custkey from customer where c_nationkey = 3")(lambda g: g.read("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).union(g.read("customer").where("c_nationkey = 3").select("c_custkey")).distinct())
query("set_append", "select r_name n, null::int k from region union all select n_name, n_regionkey from nation")(lambda g: g.read("region").select(F.col("r_name").alias("n")).unionByName(g.read("nation").select(F.col("n_name").alias("n"), F.col("n_regionkey").alias("k")), allowMissingColumns=True))
_HALVE = lambda g: g("entity").where("id like 's%'").select("id", F.concat(F.lit("s"), F.floor(F.substring("id", 2, 9).cast("long") / 4).cast("string")).alias("canonical"))
_CUT = "'s' || (substr({0}, 2)::bigint // 4)"
query("j_repoint", f"select * from (select {_CUT.format('source_id')} source_id, {_CUT.format('target_id')} target_id, amount from edge where edge_type = 'PAID_TO') where source_id <> target_id", "edge")(lambda g: M.repoint(g("edge").where("edge_type = 'PAID_TO'"), _HALVE(g)).select("source_id", "target_id", "amount"))
query("j_mentions", "select entity_id, doc_id from mention where doc_id is not null", "mention")(lambda g: g("mention").where("doc_id is not null").select("entity_id", "doc_id"))
query("j_anti", f"select id from entity where {_FREE}", "entity", "edge", "mention")(lambda g: C.unlinked(g("entity"), g("edge"), g("mention")).select("id"))
query("j_hydrate", "select id, s_name, rank from (select concat('s', s_suppkey) id, s_name, s_suppkey + 1 rank from supplier where s_suppkey < 12)")(
    lambda g: S.hydrate(g.read("supplier").where("s_suppkey < 12").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") + 1).alias("rank")), g.read("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), "s_name")).select("id", "s_name", "rank")
)
query("j_sibling", "select a.n_name x, b.n_name y from nation a join nation b on a.n_name < b.n_name and a.n_regionkey = b.n_regionkey")(
    lambda g: V.siblings(g.read("nation").select(F.col("n_name").alias("name"), F.array(F.col("n_regionkey").cast("string")).alias("ns"), F.array().cast("array<string>").alias("a"), F.lit("").alias("registrar"))).select("x", "y")
)
query("j_manifest", "select * from (values ('L1', 'ab-1', 'ab-1'), ('L2', 'grp-9', 'cd-2'), ('L2', 'grp-9', 'cd-3')) v(ledger_id, token, artifact_id)")(
    lambda g: V.link(g.values([("L1", "see ab-1"), ("L2", "grp-9 / zz-0")], "ledger_id string, artifact string"), g.values([("ab-1", ""), ("cd-2", "grp-9"), ("cd-3", "grp-9")], "artifact_id string, capture_group string"))
)
query("j_denylist", "select 'doc-' || doc_id path, t token from documents, (values ('license'), ('reserved')) v(t) where contains(lower(text), t)")(lambda g: V.minimise_gate(g("document").select(F.col("id").alias("path"), "text"), ["License", "reserved"]))

# --- merging and aggregates ------------------------------------------------------------------

_EDGES2 = f"e as (select {_CUT.format('source_id')} source_id, {_CUT.format('target_id')} target_id, edge_type, amount, currency, share_pct from edge where edge_type in ('PAID_TO', 'OWNS')), f as (select * from e where source_id <> target_id)"
_CLASS = """, c as (select source_id, target_id, edge_type, count(*) n, count(distinct (coalesce(amount::varchar, '~') || '|' || coalesce(currency, '~') || '|' || coalesce(share_pct::varchar, '~'))) kinds, count(distinct currency) cur, count(distinct share_pct) sh from f group by all),
    k as (select source_id, target_id, edge_type, n, case when kinds > 1 and (cur > 1 or sh > 1) then 'review' when kinds > 1 then 'reaggregated' else 'safe' end bucket, case when kinds > 1 and cur > 1 then 'currency_mismatch' when kinds > 1 and sh > 1 then 'non_additive_conflict:share_pct' end reason from c)"""
_meet = lambda g: M.repoint(g("edge").where("edge_type in ('PAID_TO', 'OWNS')"), _HALVE(g)).select(*M.KEY, "amount", "currency", "share_pct", "ord")
query("agg_classify", f", {_EDGES2}{_CLASS} select * from k", "edge")(lambda g: M.classify(_meet(g)))
query("m_lossless", f", {_EDGES2}{_CLASS} select bucket, reason, count(*) keys, sum(n)::bigint edges from k group by all", "edge")(lambda g: M.classify(_meet(g)).groupBy("bucket", "reason").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("edges")))
query("agg_reagg", f", {_EDGES2}{_CLASS} select source_id, target_id, edge_type, case when max(bucket) = 'reaggregated' then sum(amount::decimal(28, 4))::double else min(amount) end amount from f join k using (source_id, target_id, edge_type) where bucket <> 'review' group by all", "edge")(lambda g: M.plan(_meet(g))[0].select(*M.KEY, "amount"))
query("agg_first", "select o_custkey, min(o_orderkey) o_orderkey from orders group by 1")(lambda g: M.first_seen(g.read("orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey"))
query("x_dedup", "select o_custkey, o_orderpriority, min(o_orderkey) o from orders group by all")(lambda g: M.first_seen(g.read("orders").withColumn("ord", F.col("o_orderkey")), ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("o")))
query("w_ord", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey)::int n from orders")(lambda g: g.read("orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).select("o_orderkey", "n"))
_SIMPLE = "p as (select distinct least(source_id, target_id) u, greatest(source_id, target_id) v from edge where source_id <> target_id), b as (select u, v from p union all select v, u from p)"
query("ga_project", f", {_SIMPLE} select u, v from p", "edge")(lambda g: G.simple(g("edge")))
query("agg_degree", f", {_SIMPLE} select u id, count(*) degree from b group by 1", "edge")(lambda g: G.degrees(G.simple(g("edge"))))
query("agg_parallel", "select source_id, target_id, currency, sum(amount_e4)::bigint / 10000.0e0 amount from (select source_id, 's' || (substr(target_id, 2)::bigint // 10) target_id, currency, amount_e4 from funded where amount_e4 > 0) group by all", "funded")(
    lambda g: G.money_graph(g("funded").withColumns({"target_id": F.concat(F.lit("s"), F.floor(F.substring("target_id", 2, 9).cast("long") / 10).cast("string")), "amount": F.col("amount_e4") / 10000.0})).select("source_id", "target_id", "currency", "amount")
)
query("edge_funded", "select * from funded", "funded")(lambda g: g("funded"))
query("agg_health", f"""select round((select count(distinct entity_type) from entity where entity_type in ({', '.join(repr(t) for t in TYPES)})) / {len(TYPES)}.0e0, 6) icr, round((select max(n) / sum(n)::double from (select count(*) n from entity group by entity_type)), 6) ci,
    round((select count(distinct edge_type) from edge where edge_type in ({', '.join(repr(e[0]) for e in EDGES)})) / {len(EDGES)}.0e0, 6) ipr""", "entity", "edge")(lambda g: Q.health(g("entity"), g("edge"), TYPES, [e[0] for e in EDGES]).select("icr", "ci", "ipr"))
query("agg_prf", "with n as (select (select count(*) from part where p_size < 20) a, (select count(*) from part where p_size between 10 and 30) b, (select count(*) from part where p_size between 10 and 19) c) select c / a \"precision\", c / b recall, 2 * (c / a) * (c / b) / (c / a + c / b) f1 from n")(lambda g: Q.prf(g.read("part").where("p_size < 20"), g.read("part").where("p_size between 10 and 30"), ["p_partkey"]))
query("agg_bcubed", """with i as (select p_size % 10 c, p_size % 4 g from part), x as (select c, g, count(*) n from i group by all), t as (select *, sum(n) over (partition by c) nc, sum(n) over (partition by g) ng, sum(n) over () m from x),
    s as (select sum(n * n / nc) / max(m) p, sum(n * n / ng) / max(m) r from t) select round(p, 9) as \"precision\", round(r, 9) recall, round(2 * p * r / (p + r), 9) f1 from s""")(lambda g: Q.bcubed(g.read("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("cluster"), (F.col("p_size") % 4).alias("gold"))))
GOLD = [(1, "a", "OWNS", "b"), (1, "b", "OWNS", "c"), (2, "x", "PAID_TO", "y")]
GOT = [(1, "a", "OWNS", "b"), (1, "a", "OWNS", "c"), (2, "x", "PAID_TO", "y"), (3, "q", "OWNS", "r")]
query("ev_triples", "select 0.5e0 as \"precision\", 0.5e0 recall, 0.5e0 f1, 3::bigint sentences")(lambda g: Q.triples(g.values(GOT, "sid int, s string, t string, o string"), g.values(GOLD, "sid int, s string, t string, o string")))

# --- search ----------------------------------------------------------------------------------

WORDS = "license version reserved"
_TOK = "[t for t in regexp_split_to_array(translate(lower(concat_ws(' ', body, title)), '" + X.ACCENTS + "', '" + X.PLAIN + "'), '[^a-z0-9]+') if t <> '' and not list_contains([" + ", ".join(repr(w) for w in S.STOP) + "], t)]"
# The words that have the stems of WORDS, spelt out.
_STEM = "case when regexp_full_match(w, 'licens(e|es|ed|ing|er|ers)?') then 'licens' when regexp_full_match(w, 'versions?') then 'version' when regexp_full_match(w, 'reserv(e|es|ed|ing|ation|ations)?') then 'reserv' end"
_BM = f""", tk as (select id, {_TOK} t from chunk where sensitivity = 'public'), st as (select count(*) n, avg(len(t)) a from tk),
    tf as (select id, len(t) l, {_STEM} term, count(*) tf from (select id, t, unnest(t) w from tk) where term is not null group by all), df as (select term, count(*) df from tf group by 1),
    sc as (select id, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * l / a))), 6) score from tf join df using (term), st group by id)"""
query("r_bm25", _BM + " select id, score, row_number() over (order by score desc, id)::int rank from sc order by score desc, id limit 12", "document", "chunk")(lambda g: S.bm25(g("chunk"), WORDS))
query("w_bm25_rank", _BM + " select id, row_number() over (order by score desc, id)::int rank from sc order by score desc, id limit 50", "document", "chunk")(lambda g: S.bm25(g("chunk"), WORDS, limit=50).select("id", "rank"))
query("r_fts_index", f", tk as (select id, {_TOK} t from chunk) select term, id, len(t)::int len, count(*) tf from (select id, t, unnest(t) term from tk) group by all", "document", "chunk")(lambda g: S.postings(g("chunk"), stems=False)[0].select("term", "id", "len", "tf"))
_items = lambda g: g.read("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
_vec = lambda g: [float(x) for x in g.read("embeddings").where("vec_id = 7").first()["embedding"]]
_VD = "vd as (select b.vec_id::varchar id, round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) distance from embeddings a, embeddings b where a.vec_id = 7)"
query("r_vector", f"with {_VD} select id, distance, row_number() over (order by distance, id)::int rank from vd order by distance, id limit 12")(lambda g: S.vector(_items(g), _vec(g)))
query("w_vec_rank", f"with {_VD} select id, row_number() over (order by distance, id)::int rank from vd order by distance, id limit 50")(lambda g: S.vector(_items(g), _vec(g), 50).select("id", "rank"))
query("r_hnsw", f"with {_VD} select id from vd order by distance, id limit 10")(lambda g: S.vector(_items(g), _vec(g), 10).select("id"))
_LISTS = "a as (select o_orderkey::varchar id, row_number() over (order by o_totalprice desc, o_orderkey)::int ra from orders qualify ra <= 50), b as (select o_orderkey::varchar id, row_number() over (order by o_custkey, o_orderkey)::int rb from orders qualify rb <= 50)"
_top = lambda g, *o: (lambda w: g.read("orders").orderBy(*o).limit(50).withColumn("rank", F.row_number().over(w)).select(F.col("o_orderkey").cast("string").alias("id"), "rank"))(Window.orderBy(*o))
_RRF = f"with {_LISTS}, s as (select id, ra, rb, round(coalesce(1 / (60.0e0 + ra), 0) + coalesce(1 / (60.0e0 + rb), 0), 9) score from a full join b using (id)) select id, score, row_number() over (order by score desc, id)::int rank from s order by score desc, id limit 12"
query("j_rrf", _RRF)(lambda g: S.fuse(_top(g, F.desc("o_totalprice"), "o_orderkey"), _top(g, "o_custkey", "o_orderkey")).select("id", "score", "rank"))
#: Chunks with the vector of their document, where it has one.
_told = lambda g: g("chunk").join(g.read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
_BOTH = _BM + """, vd as (select c.id, round(1 - list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) distance from chunk c join embeddings e on e.vec_id = c.doc_id, embeddings q where q.vec_id = 7 and c.sensitivity = 'public'),
    kl as (select id, score, row_number() over (order by score desc, id)::int ra from sc qualify ra <= 50), vl as (select id, distance, row_number() over (order by distance, id)::int rb from vd qualify rb <= 50),
    hy as (select id, round(coalesce(1 / (60.0e0 + ra), 0) + coalesce(1 / (60.0e0 + rb), 0), 9) score from kl full join vl using (id)), hl as (select id, score, row_number() over (order by score desc, id)::int rank from hy qualify rank <= 12)"""
query("r_hybrid", _BOTH + " select id, score, rank from hl", "document", "chunk")(lambda g: S.hybrid(_told(g), WORDS, _vec(g)).select("id", "score", "rank"))
query("r_modes", _BOTH + ", found as (select 'fts' as mode, id, score, ra rank from kl where ra <= 12 union all select 'semantic', id, distance, rb from vl where rb <= 12 union all select 'hybrid', id, score, rank from hl) select mode, id, score, rank, doc, chunk_index from found join chunk using (id)", "document", "chunk")(
    lambda g: reduce(DataFrame.union, [S.search(_told(g), WORDS, m, _vec(g)).select(F.lit(m).alias("mode"), "id", "score", "rank", "doc", "chunk_index") for m in ("fts", "semantic", "hybrid")])
)

# --- extraction ------------------------------------------------------------------------------

query("x_phase2")(lambda g: E.provided(g("document"), E.gazetteer({"MIT License": "document", "Apache License": "document"})))
query("x_pairwise", "with e as (select conv_id doc_id, role || turn as label, turn * 100 pos from conversations) select a.doc_id, a.label a, b.label b, min(abs(a.pos - b.pos)) distance from e a join e b on a.doc_id = b.doc_id and a.label <> b.label and abs(a.pos - b.pos) <= 240 group by all")(
    lambda g: E.pair_candidates(g.read("conversations").select(F.col("conv_id").alias("doc_id"), F.concat("role", F.col("turn").cast("string")).alias("label"), (F.col("turn") * 100).alias("pos")))
)
query("x_make", "select substr(sha256(entity_type || ':' || lower(trim(label)) || ':' || source_url), 1, 16) id, label, entity_type, 0.5e0 confidence, 1700000000::bigint created_at, 1700000000::bigint updated_at from entity where entity_type in ('person', 'organization', 'location', 'asset', 'claim')", "entity")(
    lambda g: E.records(g("entity").where("entity_type <> 'concept'").select("label", "entity_type", "source_url"), 1700000000).select("id", "label", "entity_type", "confidence", "created_at", "updated_at")
)
query("x_remote", "select 'doc-' || doc_id doc_id, 'MIT License' as label from documents where regexp_matches(text, '(^|[^A-Za-z0-9_])MIT License($|[^A-Za-z0-9_])')")(lambda g: E.provided(g("document"), E.with_fallback(_unreachable, E.gazetteer({"MIT License": "document"}))).select("doc_id", "label"))
def _unreachable(text: str):
    raise ConnectionError("no such host")


WANTED = [(1, "nation 3"), (1, "Supplier#000000001"), (1, " "), (1, "zzz")]
query("f_find_entity", "select 1::bigint doc_id, 'Supplier#000000001' as label, 's1' id")(lambda g: E.find_entity(g.values(WANTED, "doc_id long, label string"), g("entity").where("id like 's%'").select(F.lit(1).cast("long").alias("doc_id"), "id", "label", F.substring("id", 2, 9).cast("long").alias("ord"))))

# --- resolution ------------------------------------------------------------------------------

_people = lambda g: (lambda s: s.select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("organization").alias("entity_type"), F.col("s_name").alias("label"), F.col("s_suppkey").alias("ord")).union(
    s.select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")), F.lit("organization"), F.concat(F.upper("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "  ").otherwise(", L.L.C.")), F.col("s_suppkey") + 1_000_000)))(g.read("supplier"))
query("er_exact", "select 'a' || s_suppkey id, 'a' || s_suppkey canonical from supplier union all select 'b' || s_suppkey, case when s_suppkey % 2 = 0 then 'a' else 'b' end || s_suppkey from supplier")(lambda g: Z.exact(_people(g)))
query("er_norm", "select 'a' || s_suppkey id, 'a' || s_suppkey canonical from supplier union all select 'b' || s_suppkey, 'a' || s_suppkey from supplier")(lambda g: Z.by_name(_people(g)))
query("er_seam", "select 'a' || s_suppkey id, 'a' || s_suppkey canonical from supplier union all select 'b' || s_suppkey, 'a' || s_suppkey from supplier")(lambda g: Z.tiers(_people(g), Z.exact, Z.by_name))
query("er_records", "select 'a' || s_suppkey kept, 'b' || s_suppkey merged, s_name kept_label, 'norm' via from supplier")(lambda g: Z.merge_records(_people(g), Z.by_name(_people(g)), "norm").select("kept", "merged", "kept_label", "via"))
query("er_fuzzy")(lambda g: Z.fuzzy_pairs(g("entity").where("entity_type in ('location', 'asset')")))
_vecs = lambda g: g.read("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("entity_type"), "embedding", F.col("vec_id").alias("ord"))
query("er_cosine", "select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) cosine from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= 0.3e0")(lambda g: Z.cosine_pairs(_vecs(g), 0.3))
_REG = """select 'c' || c_custkey id, 'organization' t, case when c_custkey % 5 = 0 then null else (c_custkey % 97)::varchar end reg, case when c_custkey % 7 = 0 then null else (c_custkey % 31) || ' park avenue' end addr, case when c_custkey % 3 = 0 then 'us' when c_custkey % 3 = 1 then 'ca' end jur, 'firm ' || (c_custkey % 41) nm from customer"""
_firms = lambda g: (lambda k: g.read("customer").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.lit("organization").alias("entity_type"), F.concat(F.lit("Firm "), (k % 41).cast("string"), F.lit(", Inc.")).alias("label"), F.when(k % 5 == 0, F.lit("--​")).otherwise((k % 97).cast("string")).alias("reg_id"),
    F.when(k % 7 == 0, "").otherwise(F.concat((k % 31).cast("string"), F.lit(" Park Ave."))).alias("address"), F.when(k % 3 == 0, "US").when(k % 3 == 1, "ca ").otherwise("").alias("jurisdiction")))(F.col("c_custkey"))
_CAND = f"with f as ({_REG}), c as (select a.id a, b.id b, a.reg ra, b.reg rb, a.addr aa, b.addr ab, a.jur ja, b.jur jb, a.nm na, b.nm nb from f a join f b on a.id < b.id and (a.reg = b.reg or (a.nm = b.nm and a.addr = b.addr)))"
_DEC = _CAND + """, d as (select a, b, case when ra = rb and aa = ab and not coalesce(ja <> jb, false) then 'merge' when ra = rb then 'review' when ra is not null or rb is not null then 'apart' when na = nb and aa = ab then 'merge' else 'apart' end decision,
    case when ra = rb and (not coalesce(aa = ab, false) or coalesce(ja <> jb, false)) then case when coalesce(ja <> jb, false) then 'jurisdiction mismatch' when aa is null or ab is null then 'address missing' else 'address mismatch' end end reason from c)"""
query("f_decide", _DEC + " select a, b, decision, reason from d")(lambda g: Z.multifield(_firms(g))[1])
query("j_block_reg", _CAND + " select a, b from c where ra = rb")(lambda g: Z.block_pairs(Z.field_keys(_firms(g)), Z.BY_REG).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
query("j_block_nameaddr", _CAND + " select a, b from c where na = nb and aa = ab")(lambda g: Z.block_pairs(Z.field_keys(_firms(g)), Z.BY_PLACE).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
query("j_block_norm", "select 'c' || a.c_custkey a, 'c' || b.c_custkey b from customer a join customer b on 'c' || a.c_custkey < 'c' || b.c_custkey and a.c_custkey % 41 = b.c_custkey % 41")(lambda g: Z.name_pairs(_firms(g)))
query("er_multifield", "with recursive" + _DEC[4:] + ", l as (select a x, b y from d where decision = 'merge' union all select b, a from d where decision = 'merge'), r as (select id, id c from f union select r.id, l.y from r join l on l.x = r.c) select id, min(c) canonical from r group by 1")(lambda g: Z.multifield(_firms(g))[0])
_ALIAS = lambda g: (lambda k: g.read("supplier").where(k % 5 < 2).select(F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.concat(F.lit("s"), (k + 1).cast("string")).alias("target_id"), F.lit("ALIAS_OF").alias("edge_type")).union(
    g.read("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.lit("s4"), F.lit("ALIAS_OF"))))(F.col("s_suppkey"))
query("er_alias", "select id, case when id like 's%' and substr(id, 2)::bigint % 5 < 3 then max(id) over (partition by id like 's%' and substr(id, 2)::bigint % 5 < 3, case when id like 's%' then substr(id, 2)::bigint // 5 end) else id end canonical from entity", "entity")(lambda g: Z.alias(g("entity"), _ALIAS(g)))
# --- graph -----------------------------------------------------------------------------------

_own = lambda g: g("edge").where("edge_type = 'OWNS'")
query("ga_cc", f", {_SIMPLE}, r as (select id, id c from entity union select r.id, b.v from r join b on b.u = r.c) select id, min(c) component from r group by 1", "entity", "edge")(lambda g: G.components(g("entity"), g("edge")))
_PAID = "m as (select source_id s, target_id t, currency c, amount a from edge where edge_type = 'PAID_TO' and amount > 0 and source_id <> target_id)"
query("ga_funds", f", {_PAID}, w as (select [s, t] p, [a] am, [c] cu from m where s in ('s0', 's1', 's2') union all select list_append(p, t), list_append(am, a), list_append(cu, c) from w join m on p[-1] = s where not list_contains(p, t) and len(p) < 9) "
    "select array_to_string(p, '>') path, len(am)::int hops, case when len(list_distinct(cu)) > 1 then 'MIXED' else cu[1] end currency, am[1] total_in, case when len(list_distinct(cu)) = 1 then list_min(am) end bottleneck from w", "edge")(
    lambda g: G.trace_funds(g("edge").where("edge_type = 'PAID_TO'"), g.values([("s0",), ("s1",), ("s2",)], "id string")).select(F.array_join("path", ">").alias("path"), "hops", "currency", "total_in", "bottleneck")
)
query("agg_bottleneck", SQL["ga_funds"].replace("select array_to_string(p, '>') path, len(am)::int hops, case when len(list_distinct(cu)) > 1 then 'MIXED' else cu[1] end currency, am[1] total_in, case", "select array_to_string(p, '>') path, case"))(
    lambda g: G.trace_funds(g("edge").where("edge_type = 'PAID_TO'"), g.values([("s0",), ("s1",), ("s2",)], "id string")).select(F.array_join("path", ">").alias("path"), "bottleneck")
)
query("s_chains", SQL["ga_funds"] + " order by total_in desc, path limit 20")(lambda g: QUERIES_RAW["ga_funds"](g).orderBy(F.desc("total_in"), "path").limit(20))
_OWNED = ", o as (select source_id s, target_id t, max(share_pct) / 100 sh from edge where edge_type = 'OWNS' and share_pct is not null and source_id <> target_id group by all), w as (select [s, t] p, sh x from o union all select list_append(p, t), x * sh from w join o on p[-1] = s where not list_contains(p, t) and len(p) < 7)"
_CTRL = _OWNED + ", q as (select p[1] source_id, p[-1] target_id, round(sum(x), 9) stake, max(len(p) - 1)::int hops from w group by all) select source_id, target_id, round(least(stake, 1), 4) effective_pct, hops from q anti join o on s = source_id and t = target_id where stake >= 0.25e0"
for _n in ("ga_control", "agg_own"):
    query(_n, _CTRL, "edge")(lambda g: G.infer_control(_own(g))[0].select("source_id", "target_id", "effective_pct", "hops"))
query("f_record", _CTRL.replace("select source_id, target_id, round(least(stake, 1), 4) effective_pct, hops from q", "select source_id, target_id, round(least(stake, 1), 4) effective_pct, printf('%.1f%%', least(stake, 1) * 100) pct from q"), "edge")(lambda g: G.infer_control(_own(g))[0].select("source_id", "target_id", "effective_pct", F.regexp_extract("evidence", "= (.*)$", 1).alias("pct")))
query("ga_from_graph", _CTRL.replace("edge_type = 'OWNS' and", "edge_type = 'OWNS' and provenance is distinct from 'inferred' and"), "edge")(lambda g: G.infer_control(C.ownership_edges(g("edge")).withColumn("edge_type", F.lit("OWNS")))[0].select("source_id", "target_id", "effective_pct", "hops"))
_STEP = ", w as (select [source_id, target_id] p, [edge_type] ty, e.confidence x from edge e where source_id = 's1' union all select list_append(p, target_id), list_append(ty, edge_type), x * e.confidence from w join edge e on p[-1] = source_id where not list_contains(p, target_id) and len(p) < 5)"
query("j_pathstep", _STEP + " select array_to_string(p, '>') path, len(p)::int - 1 hops from w where p[1] <> p[2]", "edge")(lambda g: G.paths(g("edge"), g.values([("s1",)], "id string"), 4, {"types": "edge_type"}).select(F.array_join("path", ">").alias("path"), "hops"))
_FIND = ", src as (select id from entity where contains(label, 'Supplier#000000001') order by id limit 25), dst as (select id from entity where contains(label, 'Supplier#00000001') order by id limit 25)" + _STEP.replace("source_id = 's1'", "source_id in (select id from src) and source_id <> target_id")
_FIND += " select array_to_string(p, '>') path, array_to_string(ty, '>') types, round(x, 9) score from w where p[-1] in (select id from dst) order by score desc, p, ty limit 25"
for _n in ("ga_path", "s_paths"):
    query(_n, _FIND, "entity", "edge")(lambda g: G.find_paths(g("entity"), g("edge"), "Supplier#000000001", "Supplier#00000001")[0].select(F.array_join("path", ">").alias("path"), F.array_join("types", ">").alias("types"), "score"))
query("ga_bridges", ", p as (select row_number() over () n, u, v from (select distinct least(source_id, target_id) u, greatest(source_id, target_id) v from edge where source_id <> target_id)), "
    "b as (select n, u, v from p union all select n, v, u from p), r as (select n, u here, v goal from p union select r.n, b.v, r.goal from r join b on b.u = r.here and b.n <> r.n) select u, v from p where n not in (select n from r where here = goal)", "edge")(
    lambda g: G.bridges(g("edge"))
)
query("ga_louvain")(lambda g: G.communities(g("edge")))
query("ga_betweenness")(lambda g: G.betweenness(g("edge")))
query("s_topk_betw")(lambda g: G.surprising(G.betweenness(g("edge")), G.degrees(G.simple(g("edge")))))
query("ga_gaps")(lambda g: G.gaps(G.communities(g("edge")), g("edge")))
query("ga_edge_betw")(lambda g: G.betweenness(g("edge"), edges=True))
query("ga_skeleton")(lambda g: G.skeleton(g("edge"), 50))
query("ga_homology")(lambda g: g.values([(float(a), float(b)) for a, b in G.homology(g("edge"))["h1"]], "birth double, death double"))
query("agg_modularity")(lambda g: g.values([(G.modularity(G.communities(g("edge")), g("edge")),)], "modularity double"))
query("ga_maxflow")(lambda g: g.values([(G.max_flow(g("edge").where("edge_type = 'PAID_TO' and currency = 'USD'"), "s0", "s7")["flow"],)], "flow double"))
#: Communities by nation: customers and suppliers with theirs, nations with their region's.
_COM = "com as (select 'c' || c_custkey id, 'n' || c_nationkey community from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"
_com = lambda g: reduce(DataFrame.union, [g.read(t).select(F.concat(F.lit(a), F.col(k).cast("string")).alias("id"), F.concat(F.lit(b), F.col(c).cast("string")).alias("community")) for t, a, k, b, c in (("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"))])
_CROSS = f", {_SIMPLE}, {_COM}, cr as (select least(a.community, b.community) a, greatest(a.community, b.community) b, count(*) crossed from p join com a on u = a.id join com b on v = b.id where a.community <> b.community group by 1, 2)"
_GAP = _CROSS + ", sz as (select community, count(*) size from com group by 1 having count(*) >= 5), gp as (select x.community a, y.community b, x.size size_a, y.size size_b, coalesce(crossed, 0)::bigint cross_edges, case when crossed is null then 'HIGH' else 'MEDIUM' end severity from sz x join sz y on x.community < y.community left join cr on cr.a = x.community and cr.b = y.community where coalesce(crossed, 0) <= 3)"
query("agg_cross", _CROSS + " select a, b, crossed \"cross\" from cr", "edge")(lambda g: G.cross_edges(_com(g), G.simple(g("edge"))))
query("s_topk_comm", f", {_SIMPLE}, {_COM}, d as (select u id, count(*) degree from b group by 1) select community, id, degree, row_number() over (partition by community order by degree desc, id)::int nth from d join com using (id) qualify nth <= 3", "edge")(lambda g: G.top_members(_com(g), G.simple(g("edge"))))
query("j_gap", _GAP + " select a, b, size_a, size_b, cross_edges, severity from gp", "edge")(lambda g: G.gaps(_com(g), g("edge")).select("a", "b", "size_a", "size_b", "cross_edges", "severity"))
query("s_gap", _GAP + " select a, b, severity, cross_edges from gp order by severity <> 'HIGH', cross_edges, a, b limit 15", "edge")(lambda g: G.by_severity(G.gaps(_com(g), g("edge"))).limit(15).select("a", "b", "severity", "cross_edges"))

query("ga_timeline", "select id, label, regexp_extract(label, '\\b(\\d{4})\\b', 1)::int as \"year\" from entity where regexp_matches(label, '\\b\\d{4}\\b')", "entity")(lambda g: W.timeline(W.tagged(g("entity"), _DOMAINS, _STORIES)))
query("l_caps", "select id, substr(label || repeat('.', 600), 1, 500) t from entity where entity_type = 'location'", "entity")(lambda g: g("entity").where("entity_type = 'location'").select("id", X.capped(F.concat("label", F.repeat(F.lit("."), F.lit(600)))).alias("t")))
query("l_trunc", "select id, true truncated from entity order by id limit 5", "entity")(lambda g: W.limited(g("entity").select("id").orderBy("id"), 5))
query("f_render_path", "select 'A --[OWNS]--> B (0.50)' as text")(lambda g: G.render_path(g.values([(["a", "b"], ["OWNS"], 0.5)], "path array<string>, types array<string>, score double"), g.values([("a", "A"), ("b", "B")], "id string, label string")))
query("ga_briefing")(lambda g: g.values([(T.briefing(C.new_since(g("entity"), 0), C.contradictions(g("edge"), g("entity"), 5), G.gaps(G.communities(g("edge")), g("edge")), C.unlinked(g("entity"), g("edge"), g("mention"))),)], "markdown string"))

# --- whole runs and readers ------------------------------------------------------------------

SPEC = """
entities:
  - {column: owner, type: organization}
  - {column: asset, type_column: kind}
edges:
  - {source: owner, type: OWNS, target: asset, share_pct: pct, date: as_of}
"""


def _loads(text: str) -> bool:
    try:
        return bool(tabular.Spec.load(text))
    except ValueError:
        return False


def _table(g):
    k = F.col("s_suppkey")
    rows = g.read("supplier").select(
        F.concat(F.lit("Holder "), F.floor(k / 4).cast("string")).alias("owner"), F.col("s_name").alias("asset"), F.when(k % 5 == 0, "alien").when(k % 5 == 1, "event").otherwise("company").alias("kind"),
        F.concat((k % 90).cast("string"), F.lit("%")).alias("pct"), F.lit("2024-01-02").alias("as_of"), (k + 1).alias("row_no"),
    )
    return tabular.ingest(rows, tabular.Spec.load(SPEC), "own.csv")


_HASH = "substr(sha256('organization:' || lower({0}) || ':own.csv'), 1, 16)"
query("src_tabular", f"select {_HASH.format("'holder ' || (s_suppkey // 4)")} source_id, {_HASH.format('s_name')} target_id, (s_suppkey % 90)::double share_pct, 1704153600000::bigint valid_at_ms from supplier where s_suppkey % 5 > 1")(lambda g: _table(g)["edges"].select("source_id", "target_id", "share_pct", "valid_at_ms"))
query("src_tabular_skipped", "select s_suppkey + 1 row_no, case s_suppkey % 5 when 0 then 'bad_entity_type' else 'grade_violation' end reason from supplier where s_suppkey % 5 < 2")(lambda g: _table(g)["skipped"].select("row_no", "reason"))
query("src_tabular_entities", "select distinct 'organization' entity_type, 'Holder ' || (s_suppkey // 4) as label from supplier union all select case s_suppkey % 5 when 1 then 'event' else 'organization' end, s_name from supplier where s_suppkey % 5 > 0")(lambda g: _table(g)["entities"].select("entity_type", "label"))
query("f_row_evidence", "select 'row ' || (s_suppkey + 1) || ': owner=Holder ' || (s_suppkey // 4) || ', asset=' || s_name || ', pct=' || (s_suppkey % 90) || '%, as_of=2024-01-02' evidence from supplier where s_suppkey % 5 > 1")(lambda g: _table(g)["edges"].select("evidence"))


@query("src_csv", "select n_nationkey::varchar k, n_name || ', \"the' || chr(10) || 'great\"' n, count(*) over ()::bigint n_rows from nation")
def _(g):
    path = table_path(g.spark, "csv") + ".csv"
    g.read("nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit(', "the\ngreat"')).alias("n")).coalesce(1).write.csv(path, header=True, quote='"', escape='"')
    df = files.read_table_file(g.spark, path)
    return df.select("k", "n").join(df.agg(F.max("row_no").alias("n_rows")))


def _records(g):
    """Suppliers and their owners as raw records: every second one is owned under a second spelling; a chunk tells of each edge."""
    own = _own(g).select("source_id", F.when(F.substring("target_id", 2, 9).cast("long") % 2 == 0, F.concat(F.lit("v"), "target_id")).otherwise(F.col("target_id")).alias("target_id"), "edge_type", "share_pct", "ord")
    firm = g("entity").where("id like 's%'").select("id", "entity_type", "label", "extraction_source", F.lit("doc-1").alias("source_url"), "confidence", "provenance", "created_at", F.substring("id", 2, 9).cast("long").alias("ord"))
    again = firm.where("ord % 2 = 0").withColumns({"id": F.concat(F.lit("v"), "id"), "label": F.concat(F.upper("label"), F.lit(" GmbH")), "ord": F.col("ord") + 1_000_000_000})
    ent = firm.union(again)
    named = lambda k: ent.select(F.col("id").alias(f"{k}_id"), F.col("label").alias(k))
    told = own.join(named("source"), "source_id").join(named("target"), "target_id").select(F.concat(F.lit("t"), F.col("ord").cast("string")).alias("id"), F.concat("source", F.lit(" owns "), "target", F.lit(", says the register.")).alias("body"))
    edge = own.withColumns({"extraction_source": F.lit("structured"), "source_url": F.lit("doc-1"), "provenance": F.lit("register")})
    return told, ent, edge


@query("e2e_rebuild", "select (select count(*) from supplier) entities, (select count(*) - 1 from supplier) edges, (select count(*) from documents) documents, (select count(*) from supplier where s_suppkey % 2 = 0 and s_suppkey > 0) mentions")
def _(g):
    told, ent, edge = _records(g)
    mention = ent.where("id like 'v%' and id <> 'vs0'").select(F.col("id").alias("entity_id"), F.lit("doc-1").alias("doc_id"), F.lit(1).cast("long").alias("mention_count"))
    return case.rebuild(told, ent, edge, g("document").select("id", "path"), mention)[1].select("entities", "edges", "documents", "mentions")


query("er_splink")(lambda g: Z.fellegi_sunter(_people(g)))
query("er_greedy", """with recursive pr as (select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) s from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= 0.3e0),
    nb as (select vec_id k, coalesce(list(a) filter (a is not null), []) l from embeddings left join pr on b = vec_id group by 1), r as (select (-1)::bigint k, []::bigint[] reps union all select nb.k, case when len(list_intersect(reps, l)) = 0 then list_append(reps, nb.k) else reps end from r join nb on nb.k = r.k + 1),
    rep as (select unnest(reps) h from (select reps from r order by k desc limit 1)), best as (select b, arg_max(a, (s, -a)) h from pr join rep on rep.h = a where b not in (select h from rep) group by b)
    select vec_id id, coalesce(best.h, vec_id) canonical from embeddings left join best on b = vec_id""")(lambda g: (lambda v: Z.greedy(v, Z.cosine_pairs(v, 0.3)))(_vecs(g)))

query("snk_report")(lambda g: g.values([(T.report({"entities": g("entity").count()}, G.gaps(G.communities(g("edge")), g("edge")), G.bridges(g("edge")), G.surprising(G.betweenness(g("edge")), G.degrees(G.simple(g("edge"))))),)], "json string"))
query("snk_skeleton")(lambda g: g.values([(T.skeleton_json(G.skeleton(g("edge"), 20), g("entity"), G.simple(g("edge")).count()),)], "json string"))
query("r_embed", "select id, length(body)::double d from chunk", "document", "chunk")(lambda g: S.embed(g("chunk"), lambda texts: [[float(len(t))] for t in texts]).select("id", F.get("embedding", F.lit(0)).alias("d")))

query("src_findings", "select p_partkey entity_id, unnest(list_distinct([p_brand, p_type])) doc_id from part")(lambda g: files.read_findings(g.read("part").select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("provenance")))[1])
query("src_gold", "select id, entity_type, label from (select 'n' || n_nationkey id, 'place' entity_type, n_name as label from nation union all select 'r' || r_regionkey, 'unknown', 'r' || r_regionkey from region where r_regionkey in (select n_regionkey from nation))")(
    lambda g: gold.read_gold(g.read("nation").select(F.col("n_name").alias("path"), F.format_string("---\nentities:\n- {id: n%d, type: City, canonical: '%s'}\nedges:\n- {from: n%d, type: in, to: r%d}\n---\ntext", "n_nationkey", "n_name", "n_nationkey", "n_regionkey").alias("text")), {"city": "place"})[0].select("id", "entity_type", "label")
)
query("src_onto", "select * from (values ('KNOWS', 'person', '*'), ('RUNS', 'person', 'firm'), ('RUNS', 'firm', 'firm')) v(edge_type, src, tgt)")(lambda g: Vocabulary.parse(ONTO).frame(g.spark))
query("gt_linkage", "select 'L2' ledger_id, 'missing file' problem")(lambda g: V.linkage_gate(g.values([("L1", "ab-1", "GAP"), ("L2", "cd-2", "GAP")], "ledger_id string, artifact string, status string"), g.values([("ab-1", "", "f1", "h"), ("cd-2", "", "f2", "h")], "artifact_id string, capture_group string, local_path string, sha256 string"), g.values([("f1", "h")], "local_path string, sha256 string")).select("ledger_id", "problem"))
query("gt_ledger", f"select v.id::bigint ledger_id from {values(STATES, 'id, s')} where v.id in (5, 7)")(lambda g: V.ledger_gate(g.values(STATES, "ledger_id long, status string")).select("ledger_id"))
query("gt_minimise", "select 'doc-' || doc_id path from documents where contains(lower(text), 'gnu general')")(lambda g: V.minimise_gate(g("document").select(F.col("id").alias("path"), "text"), ["GNU General"]).select("path"))
query("snk_docs", "select id, path from document union all select 'new-1', 'x' from region where r_regionkey = 0", "document")(lambda g: T.upsert(g("document").select("id", "path"), g.values([("new-1", "x")], "id string, path string")))
query("snk_edges", "select source_id, target_id, edge_type, coalesce(provenance, 'unknown') provenance, extraction_source, confidence from edge", "edge")(lambda g: T.with_defaults(g("edge")).select("source_id", "target_id", "edge_type", "provenance", "extraction_source", "confidence"))
query("snk_add_edge", "select 'a' source_id, 'doc-1' source_url", "document")(lambda g: R.provenance_gate(g.values([("a", "b", "doc-1", "", 1), ("c", "b", "ghost", "", 2), ("d", "b", "", "", 3)], "source_id string, target_id string, source_url string, provenance string, ord long"), g("document"))[0].select("source_id", "source_url"))
query("snk_backup", "select count(*) n, count(distinct id) ids from chunk", "document", "chunk")(lambda g: materialise(g("chunk"), "backup").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")))
query("stats", "select count(*) total, count(*) filter (chunk_index % 2 = 0) embedded from chunk", "document", "chunk")(lambda g: T.stats(g("chunk").withColumn("embedding", F.when(F.col("chunk_index") % 2 == 0, F.array(F.lit(1.0))))).agg(F.sum("total").alias("total"), F.sum("embedded").alias("embedded")))
query("snk_review", "select source_id, target_id, 'inferred' provenance, true needs_review from (" + SQL["ga_control"].replace("with recursive", "with recursive", 1) + ")")(lambda g: G.infer_control(_own(g))[0].select("source_id", "target_id", "provenance", "needs_review"))
COSINES = [(1, 0.93), (2, 0.9985), (3, 1.0), (4, 0.90), (5, 0.97)]
query("f_band", f"select v.id::bigint id, case when v.id in (1, 5) then 'review' else 'exclude' end verdict from {values(COSINES, 'id, c')}")(lambda g: g.values(COSINES, "id long, c double").select("id", X.semantic_verdict(F.lit("person"), F.lit("person"), F.col("c")).alias("verdict")))
query("x_source", "select extraction_source, count(*) cnt from entity group by 1", "entity")(lambda g: C.counted(g("entity"), "extraction_source"))

query("s_skeleton")(lambda g: G.skeleton(g("edge"), 25))
query("x_phase3")(lambda g: E.relations(g("chunk"), lambda body: [{"source": "text", "target": "license", "type": "MENTIONS", "evidence": body}] if "License" in body else []))
query("src_manifest", "select p_partkey::varchar artifact_id, p_size http_status from part")(lambda g: (lambda path: (g.read("part").select(F.col("p_partkey").cast("string").alias("artifact_id"), F.col("p_size").alias("http_status"), F.lit("x").alias("unheard_of")).write.json(path), files.read_manifest(g.spark, path).select("artifact_id", "http_status"))[1])(table_path(g.spark, "manifest")))
query("ev_control", "select 1.0e0 as \"precision\", 1.0e0 recall, 1.0e0 f1")(lambda g: Q.prf(G.infer_control(g.values([("P", "B", "OWNS", 100.0), ("B", "C", "OWNS", 55.0), ("D", "B", "OWNS", 30.0)], "source_id string, target_id string, edge_type string, share_pct double"))[0], g.values([("P", "C")], "source_id string, target_id string"), ["source_id", "target_id"]))
query("ev_flow", "select 1.0e0 as \"precision\", 1.0e0 recall, 1.0e0 f1")(lambda g: Q.prf(G.trace_funds(g.values([("a", "b", "PAID_TO", 100.0, "USD"), ("b", "c", "PAID_TO", 90.0, "USD"), ("a", "e", "PAID_TO", 5.0, "EUR")], "source_id string, target_id string, edge_type string, amount double, currency string"), g.values([("a",)], "id string")).select(F.array_join("path", ">").alias("p")), g.values([("a>b",), ("a>b>c",), ("a>e",)], "p string"), ["p"]))
query("ev_multifield", "select 3::bigint entities, 1::bigint reviews")(lambda g: (lambda r: r[0].agg(F.count_distinct("canonical").alias("entities")).join(r[1].where("decision = 'review'").agg(F.count(F.lit(1)).alias("reviews"))))(Z.multifield(g.values([("1", "organization", "Acme", "R1", "270 Park Ave", "US"), ("2", "organization", "ACME Inc", "r1", "270 Park Avenue", "us"), ("3", "organization", "Galaxy", "R2", "1 A St", "US"), ("4", "organization", "Tulip", "R2", "2 B St", "US")], "id string, entity_type string, label string, reg_id string, address string, jurisdiction string"))))
query("ev_dedup", "select 1.0e0 as \"precision\", 1.0e0 recall, 1.0e0 f1")(lambda g: Q.bcubed(Z.by_name(_people(g)).select("id", F.col("canonical").alias("cluster"), F.substring("id", 2, 9).alias("gold"))))
query("ev_tabular", "select count(*) edges, (select count(*) from supplier where s_suppkey % 5 < 2) skipped from supplier where s_suppkey % 5 > 1")(lambda g: (lambda t: t["edges"].agg(F.count(F.lit(1)).alias("edges")).join(t["skipped"].agg(F.count(F.lit(1)).alias("skipped"))))(_table(g)))
query("ev_ftm", "select count(*) edges from edge where edge_type = 'OWNS'", "edge")(lambda g: ftm.load(ftm.export(g("entity"), g("edge"))[0])[1].where("edge_type = 'OWNS'").agg(F.count(F.lit(1)).alias("edges")))
query("ev_pipeline", f"select count(*) filter (not {_LEGAL}) violations, count(*) filter (e.evidence <> '') with_evidence {_ENDS}", "entity", "edge")(lambda g: (lambda x: x[1].agg(F.count(F.lit(1)).alias("violations")).join(x[0].unionByName(x[1]).where("evidence <> ''").agg(F.count(F.lit(1)).alias("with_evidence"))))(R.grade_gate(g("edge"), g("entity"), Vocabulary.shipped().frame(g.spark))))

# --- floors, schemas, processors ---------------------------------------------------------------


def _floors(g):
    """A generated register: groups of a bare name and one with a legal form, a chain of owners, similar people, a donor under two names, an unsupported firm."""
    forms, n, people = ["LLC", "Inc", "Corporation", "Company", "GmbH", "Ltd"], 30, 8
    names = [(f"co{i}{v}", "organization", f"Acme {i}" + (f" {forms[i % 6]}" if v else "")) for i in range(n) for v in ("", "_v")]
    names += [(f"p{i}", "person", f"Jordan Lee {i}") for i in range(people)] + [("donorA", "organization", "Northwind Trust"), ("donorA_v", "organization", "Northwind Trust GmbH"), ("ghost", "organization", "Zzz Phantom Holdings")]
    label = {i: x for i, _, x in names}
    links = [(f"co{i}", f"co{i + 1}_v", "OWNS", None) for i in range(n - 1)] + [(f"p{i}", f"co{i}", "DIRECTOR_OF", None) for i in range(people)]
    links += [("co0", "donorA", "FUNDED_BY", 2700.0), ("co0", "donorA_v", "FUNDED_BY", 3950.0)]
    told = g.values([(f"t{k}", f"{label[a]} and {label[b]}, per the filing.") for k, (a, b, *_) in enumerate(links)], "id string, body string")
    ent = g.values([(i, t, x, "structured", "register", f"register#{i}", 0.9, 0, k) for k, (i, t, x) in enumerate(names)], "id string, entity_type string, label string, extraction_source string, source_url string, provenance string, confidence double, created_at long, ord long")
    edge = g.values([(a, b, t, m, "USD" if m else None, "structured", "register", f"register#{a}", k) for k, (a, b, t, m) in enumerate([*links, ("co1", "ghost", "OWNS", None)])], "source_id string, target_id string, edge_type string, amount_total double, currency string, extraction_source string, source_url string, provenance string, ord long")
    groups = g.values([(f"co{i}{v}", i) for i in range(n) for v in ("", "_v")] + [("donorA", n), ("donorA_v", n)], "id string, gold int")
    r = case.ground_and_resolve(told, ent, edge)
    return A.floors(r.entity, r.edge, groups, n - 1 + people + 1, people, 6650.0, "ghost")


query("ev_structured", "select * from (values ('edges', 38.0e0, 38.0e0, true), ('largest component', 1.0e0, 0.9e0, true), ('merge recall', 1.0e0, 0.8e0, true), ('people', 8.0e0, 8.0e0, true), ('edges without source', 0.0e0, 0.0e0, true), ('poison', 0.0e0, 0.0e0, true), ('money', 6650.0e0, 6650.0e0, true)) v(floor, value, needed, ok)")(_floors)


@query("ev_audit", "select * from (values ('quarantine', 'PASS', ''), ('ftm', 'PASS', ''), ('names', 'PASS', ''), ('model', 'DEGRADED', ''), ('broken', 'FAIL', 'ZeroDivisionError: division by zero'), ('verdict', 'FAIL', '')) v(name, status, detail)")
def _(g):
    own = _own(g)
    ghost = g.values([("real", "organization", "Apache License"), ("ghost", "person", "Zebediah Quagmire")], "id string, entity_type string, label string")
    checks = {
        "quarantine": lambda: [r.id for r in R.ground_entities(ghost, R.mentions(ghost, g.values([("1", "Under the Apache License.")], "id string, body string"))).collect()] == ["real"],
        "ftm": lambda: ftm.load(ftm.export(g("entity"), own)[0])[1].count() == own.count(),
        "names": lambda: Z.by_name(_people(g)).agg(F.count_distinct("canonical")).first()[0] < Z.exact(_people(g)).agg(F.count_distinct("canonical")).first()[0],
        "model": lambda: None,
        "broken": lambda: 1 / 0,
    }
    rows, verdict = A.audit(checks)
    return g.values([*rows, ("verdict", verdict, "")], "name string, status string, detail string")


query("snk_schema_graph", "select source_id, target_id, edge_type, coalesce(confidence, 0.5) confidence, coalesce(provenance, 'unknown') provenance, valid_at_ms, amount from (select *, null::bigint valid_at_ms from edge)", "edge")(lambda g: T.conform(g("edge").drop("ord"), "edge").select("source_id", "target_id", "edge_type", "confidence", "provenance", "valid_at_ms", "amount"))
query("snk_schema", "select * from (values ('chunk', 10), ('document', 7), ('edge', 14), ('entity', 12), ('mention', 3)) v(name, columns)")(
    lambda g: (lambda path: (T.create_tables(g.spark, path), g.values([(n, len(g.spark.read.parquet(f"{path}/{n}").columns)) for n in sorted(T.SCHEMAS) if n not in T.create_tables(g.spark, path)], "name string, columns int"))[1])(table_path(g.spark, "schema"))
)
query("snk_migrate", "select * from (values (3, '1,2')) v(version, steps)")(lambda g: (lambda ran: g.values([(T.migrate(1, 3, {1: lambda: ran.append("1"), 2: lambda: ran.append("2")}), ",".join(ran))], "version int, steps string"))([]))
query("src_route", "select * from (values ('a/own.csv', 'a/own.map.yaml')) v(path, mapping)")(lambda g: g.values(list(files.route(["a/own.csv", "a/own.map.yaml", "a/other.csv", "a/x.txt"]).items()), "path string, mapping string"))
query("src_spec", "select * from (values ('bad', false), ('good', true)) v(name, ok)")(lambda g: g.values([("good", _loads(SPEC)), ("bad", _loads("entities:\n  - {column: owner, type: alien}\nedges: []\n"))], "name string, ok boolean"))
query("er_cluster_tier", "select 'a' || s_suppkey id, 'a' || (s_suppkey - s_suppkey % 3) canonical from supplier union all select 'b' || s_suppkey, 'b' || s_suppkey from supplier")(
    lambda g: Z.tiers(_people(g), Z.cluster_tier(g.read("supplier").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"), F.floor(F.col("s_suppkey") / 3).cast("string").alias("cluster"))))
)
_BAND = "select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) cosine from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id"
query("er_adjudicate", f"with p as ({_BAND}) select a, b, case when cosine >= 0.3e0 or (a + b) % 2 = 0 then 'match' else 'review' end verdict from p where cosine >= 0.25e0")(
    lambda g: (lambda m, r: m.select("a", "b", F.lit("match").alias("verdict")).union(r.select("a", "b", F.lit("review"))))(*Z.adjudicate(Z.cosine_pairs(_vecs(g), 0.25), 0.3, lambda pairs: pairs.where("(a + b) % 2 = 0")))
)
query("er_create", "select 'a' || s_suppkey id, 'a' || s_suppkey canonical from supplier union all select 'b' || s_suppkey, case when s_suppkey % 2 = 0 then 'a' else 'new-b' end || s_suppkey from supplier")(
    lambda g: (lambda p: Z.create(Z.exact(p), p, lambda c: F.when(c.startswith("b"), F.concat(F.lit("new-"), c)).otherwise(c)))(_people(g))
)


@query("src_processor", "select 'table' as name, n_nationkey::varchar || ',' || n_name line from nation union all select 'own', r_name from region")
def _(g):
    path = table_path(g.spark, "media")
    g.read("nation").select("n_nationkey", "n_name").coalesce(1).write.csv(f"{path}.csv", header=True)
    reg = processors.standard()
    reg.register(processors.Processor("own", lambda p: p.endswith(".region"), lambda spark, p: {"entities": g.read("region").select(F.col("r_name").alias("line")), "edges": None, "text": None}), first=True)
    rows = reg.process(g.spark, f"{path}.csv")["text"].select(F.lit(reg.choose(f"{path}.csv").name).alias("name"), F.concat_ws(",", "n_nationkey", "n_name").alias("line"))
    return rows.union(reg.process(g.spark, "x.region")["entities"].select(F.lit(reg.choose("x.region").name), "line"))


QUERIES_RAW = {"ga_funds": lambda g: QUERIES["ga_funds"](g.spark, g.sf_dir)}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages for a search over chunks of all documents one may see."""
    prepare(spark)
    chunk = frame(spark, sf_dir, "chunk")
    return S.hydrate(S.bm25(chunk, WORDS), chunk).select("rank", "score", "id", "doc", "chunk_index")
