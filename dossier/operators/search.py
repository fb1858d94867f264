"""Passage search: BM25 over an inverted index, vectors, and rank fusion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as X
from dossier.functions.stem import stem, stemmed

K1, B = 1.2, 0.75
RRF_K, CANDIDATES, LIMIT = 60, 50, 12
FIELDS = ("body", "title")
PUBLIC = ("public",)
# Words that carry no meaning in English.
STOP = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def terms(body):
    return F.filter(F.split(X.fold(body), r"[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*STOP))


def _words(chunk: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, len, _t): the index words of all fields of a chunk, as one text."""
    there = [c for c in fields if c in chunk.columns]
    return chunk.select("id", terms(F.concat_ws(" ", *there)).alias("_t")).select("id", F.size("_t").alias("len"), "_t")


def postings(chunk: DataFrame, fields: tuple[str, ...] = FIELDS, stems: bool = True) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf, len) and one row of corpus totals (n, avgdl). Each different word is stemmed once."""
    sized = _words(chunk, fields)
    each = sized.select("id", "len", F.explode("_t").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    if stems:
        known = each.select("term").distinct().select("term", stemmed(F.col("term")).alias("stem"))
        each = each.join(known, "term").groupBy(F.col("stem").alias("term"), "id", "len").agg(F.sum("tf").alias("tf"))
    return each, sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def bm25(chunk: DataFrame, query: str, sensitivity: tuple[str, ...] = PUBLIC, limit: int = LIMIT, fields: tuple[str, ...] = FIELDS, stems: bool = True) -> DataFrame:
    """(id, score, rank) of the chunks that hold a query word, best first; only those one may see.

    The filter stands before ranking, since none is pushed through it. Words count in body and title,
    by their stems. Only words that begin like a query's stem are exploded and stemmed: a stem differs
    from its word in the last letters alone.
    """
    want = sorted({stem(t) if stems else t for t in query_terms(query)})
    heads = sorted({t[: max(1, len(t) - 3)] if stems else t for t in want})
    asked = lambda t: reduce(lambda a, h: a | t.startswith(h), heads, F.lit(False))
    sized = _words(chunk.where(F.col("sensitivity").isin(*sensitivity)), fields).select("id", "len", F.filter("_t", asked).alias("_t"))
    n, avgdl = sized.agg(F.count(F.lit(1)), F.avg("len")).first()
    each = sized.select("id", "len", F.explode("_t").alias("word"))
    each = each.select("id", "len", (stemmed(F.col("word")) if stems else F.col("word")).alias("term"))
    tf = each.where(F.col("term").isin(*want) if want else F.lit(False)).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    one = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(avgdl or 1.0))))
    # df has a row for each query word.
    score = tf.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(one), 6).alias("score"))
    return ranked(score.where("score is not null"), "score", limit, False)


def query_terms(query: str) -> list[str]:
    plain = query.lower().translate(str.maketrans(X.ACCENTS, X.PLAIN))
    return [t for t in re.split(r"[^a-z0-9]+", plain) if t and t not in STOP]


def ranked(scores: DataFrame, by: str, limit: int, ascending: bool) -> DataFrame:
    """The best rows with their rank; ties go by id. The window sees limit rows only."""
    order = [F.asc(by) if ascending else F.desc(by), F.asc("id")]
    return scores.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vector(items: DataFrame, query: list[float], limit: int = LIMIT) -> DataFrame:
    """(id, distance, rank) of the nearest by cosine distance, exactly; rows without a vector are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = items.where(F.col("embedding").isNotNull()).select("id", F.round(1 - X.cosine(F.col("embedding"), q), 6).alias("distance"))
    return ranked(d.where("distance is not null"), "distance", limit, True)


def embed(items: DataFrame, provider: Callable[[list[str]], list[list[float] | None]], text: str = "body", batch: int = 50) -> DataFrame:
    """items with a vector of each text by provider(list of texts) -> list of vectors; a batch that fails gives nulls, which stats() counts as not embedded."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for i in range(0, len(part), batch):
                some = ["" if t is None else t for t in part.iloc[i : i + batch]]
                try:
                    out += [None if v is None else [float(x) for x in v] for v in provider(some)]
                except Exception:  # noqa: BLE001
                    out += [None] * len(some)
            yield pd.Series(out, dtype=object)

    return items.withColumn("embedding", vectors(text))


def fuse(a: DataFrame, b: DataFrame, k: int = RRF_K, limit: int = LIMIT) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; a list without a row adds nothing."""
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id", "full_outer")
    return ranked(both.select("id", "ra", "rb", F.round(part("ra") + part("rb"), 9).alias("score")), "score", limit, False)


def hybrid(chunk: DataFrame, query: str, vec: list[float] | None, sensitivity: tuple[str, ...] = PUBLIC, limit: int = LIMIT) -> DataFrame:
    """Keyword and vector search fused; both see only what one may see. Without a vector, keywords alone."""
    words = bm25(chunk, query, sensitivity, CANDIDATES)
    if vec is None:
        return words.select("id", F.col("rank").alias("ra"), F.lit(None).cast("int").alias("rb"), "score", "rank").where(F.col("rank") <= limit)
    return fuse(words, vector(chunk.where(F.col("sensitivity").isin(*sensitivity)), vec, CANDIDATES), limit=limit)


def hydrate(found: DataFrame, chunk: DataFrame, score: str = "score") -> DataFrame:
    """Rows of chunks for a ranked list, in its order; the list is as short as its limit."""
    return F.broadcast(found).join(chunk, "id").orderBy("rank", "id")


def search(chunk: DataFrame, query: str, mode: str = "hybrid", vec: list[float] | None = None, sensitivity: tuple[str, ...] = PUBLIC, limit: int = LIMIT) -> DataFrame:
    """Rows of chunks, best first, by words (fts), by vector (semantic, score is the distance) or by both (hybrid)."""
    if mode == "fts":
        found = bm25(chunk, query, sensitivity, limit)
    elif mode == "semantic":
        if vec is None:
            raise ValueError("a semantic search needs a vector")
        found = vector(chunk.where(F.col("sensitivity").isin(*sensitivity)), vec, limit).withColumnRenamed("distance", "score")
    elif mode == "hybrid":
        found = hybrid(chunk, query, vec, sensitivity, limit)
    else:
        raise ValueError(f"no such mode: {mode}")
    return hydrate(found.select("id", "score", "rank"), chunk)
