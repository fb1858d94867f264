"""From raw documents to token files: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.bitmap import marked
from dossier.llm.curriculum import training_order
from dossier.llm.decontaminate import decontaminate
from dossier.llm.gru_langid import UNKNOWN, learn, predict
from dossier.llm.memory import release
from dossier.llm.queries import tokenizer_path
from dossier.llm.simhash import near_duplicates
from dossier.llm.token_files import read_token_files, write_token_files
from dossier.session import materialise, prepare, read_table, table_path

#: A document whose best language gets less than this of its positions' probability is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; those without letters or of no clear language go."""
    prepare(spark)
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    ident, text = (f"d{names.index(n)}" for n in ("doc_id", "text"))
    found = predict(plain, learn(docs), ident, text, tuple(c for c in plain.columns if c != ident))
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"d{i}").alias(n) for i, n in enumerate(names)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more): the one with the smallest doc_id.

    Rows are told apart by doc_id and a 128-bit hash of the text, so null and repeated ids lose no other
    text; of rows with one id and one text one stays. A null id comes after all others. Null and empty
    texts are copies of each other; an empty table stays empty; columns are those of docs.
    """
    prepare(spark)
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    ident, text = (F.col(f"d{names.index(n)}") for n in ("doc_id", "text"))
    full = F.coalesce(text.cast("string"), F.lit(""))
    key = {"i": ident, "x": F.xxhash64(full), "y": F.xxhash64(F.lit(1), full)}
    rows = plain.select(F.struct(ident.isNull().alias("none"), *[c.alias(k) for k, c in key.items()]).alias("row"), text.alias("text"))
    found = near_duplicates(rows, "row", "text", width=5, similarity=0.8)
    # Keys of rows that go, and of rows that are there several times, of which one stays.
    odd = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("c")).withColumn("stays", F.col("row").eqNullSafe(F.col("c")))
    odd = materialise(odd.where("n > 1 or not stays").select(*[F.col(f"row.{k}").alias(f"{k}2") for k in key], "stays"), "near-odd")
    # A bitmap of these keys parts the rows that surely stay; only the others are shuffled.
    keyed = marked(plain.withColumns(key), F.col("x"), odd.select("x2"), "doubt")
    same = F.col("i").eqNullSafe(F.col("i2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
    judged = keyed.where("doubt").join(odd, same, "left")
    kept = keyed.where("not doubt").select(*plain.columns).union(judged.where("stays is null").select(*plain.columns))
    if not odd.where("stays").isEmpty():
        kept = kept.union(judged.where("stays").dropDuplicates(list(key)).select(*plain.columns))
    return kept.toDF(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Texts without words and null texts stay, as do rows with a null id; repeated rows are judged each.
    An empty table stays empty; columns are those of docs.
    """
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; each is whole.

    Null and empty texts are taken 0 times; null is a source of its own. Repeated rows and rows without
    an id are rows like others. Columns are those of docs; an empty table stays empty.
    """
    prepare(spark)
    return training_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what reading them back gives for each.

    The files keep the training order in which the stage before wrote its rows: docs is read from its
    Parquet files, whose numbers and rows tell it. Rows that come from no file go by doc_id.
    A null text has its end id only; rows are told apart by their start, so repeated ones stay.
    """
    prepare(spark)
    release(spark)
    out = table_path(spark, "tokens")
    try:
        stored = bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        stored = False
    write_token_files(docs, out, tokenizer_path("word_bpe_49k.json"), as_stored=stored)
    return read_token_files(spark, out).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: A trained network has no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
