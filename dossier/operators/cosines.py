"""Cosines of all pairs inside groups, as products of matrices over tiles of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.session import partitions

#: Rows of a tile, about. A cell is a pair of tiles, so a group of any size is many cells.
TILE = 512
#: Rows of a cell that are compared with all of its other side at once.
ROWS = 256
#: Multiplications that a matrix library still gives to one thread.
ALONE = 1 << 18


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors padded with zeros, lengths, squared norms); a length below zero, each its own, is one of a vector that gives null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat = lists.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0))
    own = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), n.max(initial=0)))
    out[own, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    square = np.zeros(len(n))
    for k in range(out.shape[1]):
        square += out[:, k] * out[:, k]
    void = square == 0
    void[own[np.asarray(flat.is_null())]] = True
    return out, np.where(void, -1 - np.arange(len(n)), n), square


def _rounded(y: np.ndarray) -> np.ndarray:
    """Halves go away from zero."""
    whole = np.trunc(y)
    return whole + np.where(np.abs(y - whole) >= 0.5, np.copysign(1.0, y), np.copysign(0.0, y))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, in parts so small that the library takes one thread for them: the other cores have tasks of their own."""
    out, few = np.empty((len(a), len(b))), max(1, ALONE // max(1, b.size))
    turned = np.ascontiguousarray(b.T)
    for k in range(0, len(a), few):
        np.matmul(a[k : k + few], turned, out=out[k : k + few])
    return out


def _cell(least: float | None, with_key: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        vec, n, square = _matrix(table.column("v"))
        root, tile = np.sqrt(square), np.asarray(table.column("t"))
        rank = np.unique(np.array(ids.to_pylist(), object) if not pa.types.is_integer(ids.type) else np.asarray(ids), return_inverse=True)[1]
        alone = key[1].as_py() == key[2].as_py()
        x = np.flatnonzero(tile == key[1].as_py())
        y = x if alone else np.flatnonzero(tile == key[2].as_py())
        alike = len(n) and (n == n[0]).all() and n[0] > 0
        first, second, score, void = [], [], [], []
        for at in range(0, len(x), ROWS):
            i = x[at : at + ROWS]
            before = rank[i][:, None] < rank[y][None]
            keep = before if alone else rank[i][:, None] != rank[y][None]
            known = np.True_ if alike else n[i][:, None] == n[y][None]
            with np.errstate(all="ignore"):
                c = _products(vec[i], vec[y]) / (root[i][:, None] * root[y][None]) * 1e6
                # Near a half, or near zero with its sign, what counts is the sum in the vectors' order.
                p, q = np.nonzero(keep & known & ((np.abs(c - np.floor(c) - 0.5) < 1e-4) | (np.abs(c) < 1e-4)))
                c = np.rint(c)
                if len(p):
                    s, a, b = np.zeros(len(p)), i[p], y[q]
                    for k in range(vec.shape[1]):
                        s += vec[a, k] * vec[b, k]
                    both = square[a] * square[b]
                    s /= np.where((both > 1e-290) & (both < 1e290), np.sqrt(both), root[a] * root[b])
                    c[p, q] = _rounded(np.clip(s, -1, 1) * 1e6)
                c /= 1e6
                if least is not None:
                    keep = keep & known & ~(c < least)
            p, q = np.nonzero(keep)
            a, b, turn = i[p], y[q], before[p, q]
            first.append(np.where(turn, a, b))
            second.append(np.where(turn, b, a))
            score.append(c[p, q])
            if not alike:
                void.append(~known[p, q])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        cosine = pa.array(join(score, float), mask=None if alike else join(void, bool))
        cols = {"a": ids.take(pa.array(join(first, np.int64))), "b": ids.take(pa.array(join(second, np.int64))), "cosine": cosine}
        return pa.table(({"key": pa.repeat(key[0], len(cosine))} if with_key else {}) | cols)

    return run


def cosines(rows: DataFrame, key: str, ident: str, vector: str, least: float | None = None, with_key: bool = False) -> DataFrame:
    """(a, b, cosine) of all pairs of rows with one key and a < b, to six decimals; least, if given, drops pairs below it and those without a cosine.

    A group is dealt into tiles by a hash of its ids, and each pair of tiles is a cell: one product of
    matrices. So neither the number of groups nor their sizes bound the number of tasks. A row without
    id or key has no pair. The cosine is null for a null or zero vector, a null in it, or vectors of
    different lengths. Sums that lie near the edge of a rounding are summed again in order.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and id is not null")
    sizes = base.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    dealt = base.join(sizes, "key").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")))
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("key", "id", "v", "t", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))
    kinds = dict(base.dtypes)
    schema = f"key {kinds['key']}, " * with_key + f"a {kinds['id']}, b {kinds['id']}, cosine double"
    return cells.repartition(4 * partitions(spark), "key", "i", "j").groupBy("key", "i", "j").applyInArrow(_cell(least, with_key), schema)
