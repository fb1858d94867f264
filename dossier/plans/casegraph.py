"""The case graph over the shared tables: documents, chunks, entities, edges, mentions.

The projections are plain SQL that Spark and other engines read alike; operators take the frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.session import read_table

DOCUMENT = """
    select doc_id, concat('doc-', cast(doc_id as varchar(20))) as id, concat(source, '/', cast(doc_id as varchar(20))) as path, source as title, text, lang,
           case doc_id % 10 when 0 then 'confidential' when 1 then 'confirm_before_use' else 'public' end as sensitivity
    from documents"""

_SOURCE = "case k % 3 when 0 then 'deterministic' when 1 then 'llm' else 'nlp' end"
ENTITY = f"""
    select concat(p, cast(k as varchar(20))) as id, entity_type, label, c / 100.0e0 as confidence, concat('doc-', cast(k as varchar(20))) as source_url,
           {_SOURCE} as provenance, case when p = 's' then 'structured' else {_SOURCE} end as extraction_source, 1700000000 + k * 60 as created_at,
           case k % 7 when 0 then 'needs_review' when 1 then 'junk' else 'verified' end as quality_flag, (k % 5) / 10.0e0 as trust_penalty
    from (
        select 'r' as p, cast(r_regionkey as bigint) as k, 'location' as entity_type, r_name as label, 90 as c from region
        union all select 'n', cast(n_nationkey as bigint), 'location', n_name, 85 from nation
        union all select 's', s_suppkey, 'organization', s_name, cast(50 + s_suppkey % 50 as int) from supplier
        union all select 'c', c_custkey, 'person', c_name, cast(40 + c_custkey % 60 as int) from customer
        union all select 'p', p_partkey, case when p_partkey % 10 = 0 then 'concept' else 'asset' end,
            case p_partkey % 40 when 0 then concat('Session ', p_name) when 10 then concat(p_name, ' 2024-01-15') else p_name end, p_size from part
        union all select 'k', doc_id, 'claim', concat('claim ', cast(doc_id as varchar(20))), 60 from labels) t"""

_EDGE = "cast(null as double) as amount, cast(null as varchar(3)) as currency, cast(null as double) as share_pct"
EDGE = f"""
    select source_id, target_id, edge_type, 0.5e0 + (o % 50) / 100.0e0 as confidence, concat('row ', cast(o as varchar(20))) as evidence,
           case o % 9 when 0 then cast(null as varchar(9)) when 1 then 'inferred' else 'table' end as provenance,
           case o % 3 when 0 then 'llm' else 'structured' end as extraction_source,
           case o % 4 when 0 then concat('doc-', cast(o % 50 as varchar(20))) when 1 then '' else concat('lost-', cast(o as varchar(20))) end as source_url,
           1700000000 + o * 30 as created_at, amount, currency, share_pct, o as ord
    from (
        select concat('c', cast(c_custkey as varchar(20))) as source_id, concat('n', cast(c_nationkey as varchar(20))) as target_id, 'LOCATED_AT' as edge_type, {_EDGE}, c_custkey as o from customer
        union all select concat('s', cast(s_suppkey as varchar(20))), concat('n', cast(s_nationkey as varchar(20))), 'LOCATED_AT', {_EDGE}, s_suppkey from supplier
        union all select concat('n', cast(n_nationkey as varchar(20))), concat('r', cast(n_regionkey as varchar(20))), 'LOCATED_AT', {_EDGE}, cast(n_nationkey as bigint) from nation
        union all select concat('s', cast(s_suppkey div 2 as varchar(20))), concat('s', cast(s_suppkey as varchar(20))), 'OWNS', cast(null as double), cast(null as varchar(3)),
            cast(30 + s_suppkey % 70 as double), s_suppkey + 2 from supplier where s_suppkey > 0
        union all select concat('s', cast(s_suppkey as varchar(20))), concat('s', cast((11 * s_suppkey + 7) % n_suppliers as varchar(20))), 'PAID_TO', cast(1000 + s_suppkey as double),
            case s_suppkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'CAD' end, cast(null as double), s_suppkey + 3 from (select s_suppkey, count(*) over () as n_suppliers from supplier) p
        union all select concat('k', cast(a.doc_id as varchar(20))), concat('k', cast(b.doc_id as varchar(20))), 'CONTRADICTS', {_EDGE}, a.doc_id
            from labels a join labels b on b.doc_id = a.doc_id + 1 where a.quality <> b.quality) t"""

FUNDED = """
    select concat('c', cast(o_custkey as varchar(20))) as source_id, concat('s', cast(l_suppkey as varchar(20))) as target_id, 'FUNDED_BY' as edge_type,
           cast(sum(cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint))) as bigint) as amount_e4,
           case o_custkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'CAD' end as currency, count(*) as contribution_count
    from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, l_suppkey"""

MENTION = "select concat('s', cast(s_suppkey as varchar(20))) as entity_id, concat('doc-', cast(s_suppkey as varchar(20))) as doc_id, 1 as mention_count from supplier where s_suppkey % 2 = 0"

_TABLES = {
    "document": (DOCUMENT, ["documents"]),
    "entity": (ENTITY, ["region", "nation", "supplier", "customer", "part", "labels"]),
    "edge": (EDGE, ["customer", "supplier", "nation", "labels"]),
    "funded": (FUNDED, ["orders", "lineitem"]),
    "mention": (MENTION, ["supplier"]),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the case graph."""
    if name == "chunk":
        d = frame(spark, sf_dir, "document")
        w = d.select("doc_id", F.col("id").alias("doc"), "path", "title", "sensitivity", F.posexplode(X.windows(F.col("text"))).alias("chunk_index", "body"))
        return w.select(X.uuid5(F.concat("path", F.lit(":"), F.col("chunk_index").cast("string"))).alias("id"), "doc", "doc_id", "title", "sensitivity", "chunk_index", "body")
    sql, tables = _TABLES[name]
    for t in tables:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in tables})


def oracle(*names: str) -> str:
    """The same tables as common table expressions."""
    out = []
    for name in names:
        if name == "chunk":
            uuid = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(path || ':' || i))"
            out.append(
                f"""chunk as (select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) id,
                doc, doc_id, title, sensitivity, i::int chunk_index, body from (select {uuid} h, id doc, doc_id, title, sensitivity, i, substr(text, (i * 800 + 1)::int, 1000) body
                from (select *, unnest(range(0, (greatest(length(text) - 1, 0) // 800) + 1)) i from document where trim(text) <> '')))"""
            )
        else:
            out.append(f"{name} as ({_TABLES[name][0].replace(' div ', ' // ')})")
    return "with recursive " + ", ".join(out) + " "
