"""Queries of this subpackage over the shared tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.curriculum import by_position, mix
from dossier.llm.decontaminate import find_contamination
from dossier.llm.exact_dedup import exact_dedup
from dossier.llm.gru_langid import language_id
from dossier.llm.license_scan import scan_licences
from dossier.llm.rff_quality import quality
from dossier.llm.simhash import near_duplicates
from dossier.llm.substring_dedup import remove_repeats
from dossier.llm.token_counts import token_counts
from dossier.llm.token_files import read_token_files, write_token_files
from dossier.session import prepare, read_table, table_path


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers; they stay where they are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table_path(spark, "tokens")
    write_token_files(read_table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, out).withColumnRenamed("doc", "doc_id")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_matches", F.array_join("licences", ",").alias("licences"), "best_licence", "best_dice")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = by_position(mix(read_table(spark, sf_dir, "documents")))
    place = lambda k: F.round(F.try_element_at("places", F.lit(k))["position"], 9)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("places").cast("long").alias("copies"), place(1).alias("first_position"), place(-1).alias("last_position"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_files": op5_token_files,
    "op6_licence_scan": op6_licence_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix": op8_mix,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS1 = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_decontaminate": f"""
        with d as (select doc_id, {_WORDS1} w from documents),
        b as (select item_id::varchar item, {_WORDS1} w from benchmark),
        win as (
            select distinct item, 10 n, array_to_string(w[i:i + 9], ' ') g
            from (select item, w, unnest(range(1, len(w) - 8)) i from b where len(w) >= 10)
            union
            select distinct item, len(w)::int n, array_to_string(w, ' ') g from b where len(w) between 1 and 9),
        ns as (select distinct n from win),
        spots as (
            select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') g
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, ns where len(w) >= n)),
        hit as (select doc_id, i, spots.n, item from spots join win on spots.n = win.n and spots.g = win.g),
        cover as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from hit) group by 1),
        its as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) s from hit group by 1)
        select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
               sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from d left join cover using (doc_id) left join its using (doc_id)""",
    "op4_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
        win as (
            select doc_id, i, array_to_string(w[i:i + 34], ' ') g
            from (select doc_id, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
        many as (select g from win group by g having count(*) > 1),
        gone as (select distinct doc_id, unnest(range(i, i + 35)) k from win join many using (g)),
        kept as (
            select doc_id, string_agg(word, ' ' order by k) s, count(*) n
            from (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) k from d) anti join gone using (doc_id, k) group by 1)
        select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(s, '')) kept_sha256
        from d left join kept using (doc_id)""",
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over w keep_id, count(*) over w::bigint group_size,
               doc_id = max(doc_id) over w kept, sha256(coalesce(text, '')) text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op8_mix": r"""
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
                   md5('mix ' || coalesce(doc_id::varchar, '')) draw
            from documents),
        s as (select source, sum(size)::bigint n, 1 + (row_number() over (order by source nulls last) - 1) % 3 wt from d group by source),
        o as (
            select *, row_number() over (order by 3 * n / wt::double, source nulls last) k from s),
        c as (
            select *, (sum(n) over ())::bigint - coalesce(sum(3 * n) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint l,
                   (sum(wt) over (order by k rows between current row and unbounded following))::bigint v from o),
        f as (select *, min(k) filter (where l * wt < 3 * n * v) over () k0 from c),
        t as (
            select source, n, case when k0 is null or k < k0 then (3 * n)::double
                else (select g.l from f g where g.k = f.k0) * wt / (select g.v from f g where g.k = f.k0)::double end target from f),
        r as (select source, (row_number() over (order by source nulls last) - 1) nth, count(*) over () many from s),
        e as (select source, case when many > 1 then 2.0::double * nth / (many - 1) - 1.0 else 0.0 end bend from r),
        p as (
            select doc_id, size, n, target, least(3 * n, floor(target + 0.5)::bigint) words, 1.0 - 0.5 * bend w0, 1.0 + 0.5 * bend w1,
                   coalesce(sum(size) over (partition by d.source order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint start
            from d join t on d.source is not distinct from t.source join e on d.source is not distinct from e.source),
        q as (
            select *, case when n = 0 then 0 else words // n end passes, case when n = 0 then 0 else greatest(0, least(size, words % n - start)) end more from p),
        g as (select *, case when size = 0 then 0 else passes + (more > 0)::int end copies from q),
        h as (
            select *, (0 * n + start)::double / words * (w0 + w1) / 2 a, ((copies - 1) * n + start)::double / words * (w0 + w1) / 2 b from g)
        select doc_id, size, n source_size, target, (passes * size + more)::bigint taken, copies::bigint copies,
               case when copies > 0 then round(2 * a / (w0 + sqrt(w0 * w0 + 4 * ((w1 - w0) / 2) * a)), 9) end first_position,
               case when copies > 0 then round(2 * b / (w0 + sqrt(w0 * w0 + 4 * ((w1 - w0) / 2) * b)), 9) end last_position
        from h""",
}


def _prepared(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict:
    return {name: _prepared(f) for name, f in QUERIES.items()}
