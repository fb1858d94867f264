"""Stages of the pipeline keep whole texts, and drop rows, not ids."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from dossier.llm import curriculum


def test_mixing_takes_whole_documents(spark, small):
    rows = [(k, "\n".join(f"w{k}_{i}" for i in range(20 + 7 * k)), f"s{k % 4}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = {i: t for i, t, _ in rows}
    mixed = curriculum.mix(docs).collect()
    assert [p for r in mixed for p in r.places if p.words < r.size]
    got = corpus_pipeline.mixing(spark, docs, small).collect()
    assert all(r.text == text[r.doc_id] for r in got)
    # The one document in doubt is on the side that is nearer the target.
    for s in {r.mix_source for r in mixed}:
        words = sum(len(r.text.split()) for r in got if r.source == s)
        target = next(r.target for r in mixed if r.mix_source == s)
        assert abs(words - target) <= max(r.size for r in mixed if r.mix_source == s) / 2 + 0.5


def test_near_dedup_drops_rows_not_ids(spark, small):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a clean text without id"), (None, "one more clean text without id"), (1, long), (5, long + " end"), (5, "quite another text under this id"), (None, long), (7, "twice the same row"), (7, "twice the same row"), (None, "twice without id"), (None, "twice without id")]
    want = Counter([*rows[:3], rows[4], rows[6], rows[8]])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, corpus_pipeline.near_dedup(spark, docs, small).collect())) == want


def test_token_files_keep_the_training_order(spark, small, tmp_path):
    rows = [(k % 50, f"word{k % 7} " * (1 + k % 13), f"s{k % 4}", k) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, nth long").repartitionByRange(12, "nth").sortWithinPartitions("nth")
    docs.select("doc_id", "text", "source").write.option("parquet.block.size", 1024).parquet(str(tmp_path / "d"))
    got = corpus_pipeline.token_output(spark, spark.read.parquet(str(tmp_path / "d")), small).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [k % 50 for k in range(900)]
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_stages_of_empty_tables_and_clashing_names(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (90_001, "", "en", None, 0), (90_001, "", "en", None, 0)], docs.schema)
    more = docs.union(odd).withColumns({c: F.lit("x") for c in ("_id", "_size", "_place", "_text", "d0", "k1", "row", "doubt", "stays", "i", "x", "y", "u", "lang_pred", "score")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, small)
        assert name == "token_output" or out.columns == more.columns
        assert out.count() > docs.count() // 2, name
        none = stage(spark, docs.limit(0), small)
        assert name == "token_output" or none.columns == docs.columns
        assert none.count() == 0, name


def test_the_whole_run(spark, small):
    got = corpus_pipeline.run(spark, small).collect()
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert got and ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
