"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.gru_langid import held_out
from dossier.llm.memory import lean
from dossier.llm.words import slices, spans, utf8, word_hashes
from dossier.session import materialise

FEATURES = 256
RIDGE = 1e-3
#: Bins of the calibration curve over raw scores from BIN_LOW to BIN_HIGH.
BINS, BIN_LOW, BIN_HIGH = 2048, -0.5, 1.5
#: Of the labelled rows, one in so many fits the calibration instead of the ridge.
CALIBRATE = 5
CLIP = 4.0
NAMES = (
    "log bytes", "log words", "word length", "word length spread", "upper", "digit", "mark", "odd mark", "exclaim", "stop and comma", "wide", "break", "log line words",
    "repeated word", "new words", "new pairs", "new lines", "entropy", "most common word", "short words", "long words", "upper first", "mark run",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_MARK = _class("".join(chr(b) for b in range(33, 127) if not chr(b).isalnum()))
_ODD, _EXCLAIM, _STOP, _BREAK = _class("#$%&*|@^~<>{}[]=+_\\/"), _class("!"), _class(".,"), _class("\n")
_WIDE = np.zeros(256, np.int64)
_WIDE[128:] = 1


def _distinct(values: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group: how many different values, and how often the most common one occurs."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, g[at], np.diff(np.append(at, len(v))))
    return np.bincount(g[at], minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """NAMES of each text of a column, from all its bytes, words and lines."""
    data, at = utf8(column)
    n, size = len(at) - 1, np.diff(at)
    starts, ends, first = spans(data, at)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    length = ends - starts
    hashes = word_hashes(data, starts, ends)
    total = lambda table: np.diff(np.append(0, np.cumsum(table[data]))[at])
    by_size, by_words = np.maximum(1, size), np.maximum(1, words)
    mean = np.bincount(doc, length, n) / by_words
    spread = np.sqrt(np.maximum(0, np.bincount(doc, length.astype(float) ** 2, n) / by_words - mean**2))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    kinds, most = _distinct(hashes, doc, n)
    with np.errstate(over="ignore"):
        pair = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    inside = doc[1:] == doc[:-1]
    pairs, _ = _distinct(pair[inside], doc[1:][inside], n)
    # Lines as hashes of their words: a new line begins where a break lies between two words.
    breaks = np.append(0, np.cumsum(_BREAK[data]))
    line = breaks[starts] if len(starts) else np.zeros(0, np.int64)
    opens = np.ones(len(starts), bool)
    opens[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    lines = np.bincount(doc[opens], minlength=n)
    if len(starts):
        with np.errstate(over="ignore"):
            place = np.arange(len(starts)) - np.maximum.accumulate(np.where(opens, np.arange(len(starts)), 0))
            whole = np.add.reduceat(hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), np.flatnonzero(opens))
        new_lines, _ = _distinct(whole, doc[opens], n)
    else:
        new_lines = np.zeros(n, np.int64)
    count = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=256 * n).reshape(n, 256)
    p = count / by_size[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    marks = _MARK[data]
    run = np.zeros(len(data), np.int64)
    run[1:] = marks[1:] & marks[:-1]
    runs = np.diff(np.append(0, np.cumsum(run))[at])
    head = np.bincount(doc, _UPPER[data[starts]], n) if len(starts) else np.zeros(n)
    return np.stack(
        [
            np.log1p(size), np.log1p(words), mean, spread, total(_UPPER) / by_size, total(_DIGIT) / by_size, total(_MARK) / by_size, total(_ODD) / by_size,
            total(_EXCLAIM) / by_size, total(_STOP) / by_words, total(_WIDE) / by_size, total(_BREAK) / by_words, np.log1p(words / np.maximum(1, lines)),
            np.bincount(doc, same, n) / by_words, kinds / by_words, pairs / np.maximum(1, words - 1), new_lines / np.maximum(1, lines), entropy, most / by_words,
            np.bincount(doc, length <= 2, n) / by_words, np.bincount(doc, length >= 12, n) / by_words, head / by_words, runs / by_words,
        ],
        axis=1,
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in slices(batch.column(1), 1 << 20):
            x = statistics(batch.column(1).slice(i, j - i))
            flat = pa.array(np.ascontiguousarray(x).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), flat)], ["_id", "stats"])


class Model:
    """Scale of the statistics, random features, ridge weights and calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        # The kernel exp(-|x - y|^2 / (2 d)): frequencies from N(0, 1 / d).
        self.w, self.b = rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta, self.knots, self.levels = np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score; one part in a hundred is the raw score's, so that steps keep an order."""
        raw = self.raw(x)
        return 0.99 * np.interp(raw, self.knots, self.levels) + 0.01 * np.clip((raw - BIN_LOW) / (BIN_HIGH - BIN_LOW), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _normal(model: Model):
    """A partition's share of the normal equations: a row of sums for each feature, then one for the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        rows = 0
        for batch in batches:
            f = model.features(_matrix(batch.column(0)))
            a += f.T @ f
            b += f.T @ np.asarray(batch.column(1), np.float64)
            rows += len(f)
        if rows:
            m = np.vstack([a, b])
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(m) + 1) * m.shape[1]).astype(np.int32)), pa.array(m.reshape(-1)))
            n = len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, TaskContext.get().partitionId() % 64)), lists], ["row", "salt", "sums"])

    return run


def _summed(key, table):
    m = _matrix(table.column("sums").combine_chunks())
    flat = pa.array(m[np.lexsort(m.T[:4])].sum(axis=0))
    return pa.table({"row": [key[0].as_py()], "sums": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)})


def fit(stats: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> Model:
    """A model from all labelled rows outside the fold; stats has _id and stats, labels _id and label.

    What reaches the driver has a fixed size: moments of the statistics, the sums of the normal
    equations and the bins of the calibration. Without two kinds of labels the score is constant.
    """
    good = labels.where(F.col("label").isNotNull() & F.col("_id").isNotNull()).groupBy("_id").agg(F.avg("label").cast("double").alias("label"))
    rows = stats.where(~held_out(F.col("_id"), folds, fold)).join(good, "_id").withColumn("part", F.pmod(F.xxhash64(F.lit("calibrate"), F.col("_id").cast("string")), F.lit(CALIBRATE)))
    rows = materialise(rows.select("stats", "label", "part"), "labelled")
    moments = {r[0]: r for r in rows.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.avg("x"), F.stddev_pop("x")).collect()}
    d = len(NAMES)
    model = Model(np.array([moments[k][1] if k in moments else 0.0 for k in range(d)]), np.array([moments[k][2] if k in moments else 1.0 for k in range(d)]))
    seen = rows.agg(F.avg("label"), F.min("label"), F.max("label"), F.count(F.lit(1))).first()
    if not seen[3] or seen[1] == seen[2]:
        model.levels = np.array([0.5 if seen[0] is None else float(seen[0])])
        return model
    sums = rows.where("part > 0").select("stats", "label").mapInArrow(lean("quality", _normal(model)), "row long, salt long, sums array<double>")
    sums = sums.groupBy("row", "salt").applyInArrow(_summed, "row long, sums array<double>").groupBy("row").applyInArrow(_summed, "row long, sums array<double>")
    m = np.array([r[1] for r in sorted(sums.collect())])
    if not len(m):
        model.levels = np.array([float(seen[0])])
        return model
    a, b = m[:-1], m[-1]
    n = a[-1, -1]
    model.beta = np.linalg.solve(a + RIDGE * n * np.eye(len(a)) * np.append(np.ones(FEATURES) * 2 / FEATURES, 1e-6), b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch.column(0))) - BIN_LOW) / (BIN_HIGH - BIN_LOW) * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "label"])

    bins = sorted(tuple(r) for r in rows.where("part = 0").select("stats", "label").mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.sum("label"), F.count(F.lit(1))).collect())
    if bins:
        x = np.array([BIN_LOW + (k + 0.5) * (BIN_HIGH - BIN_LOW) / BINS for k, _, _ in bins])
        w = np.array([c for _, _, c in bins], float)
        model.knots, model.levels = x, isotonic(np.array([s for _, s, _ in bins]) / w, w)
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per row of docs: id, held_out, score in [0, 1] (higher: label 1 likelier), predicted.

    Scores come from the text alone. Null counts as empty; repeated rows are scored each. Several
    labels of one id are averaged; null labels and null ids teach nothing. Extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    stats = materialise(docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text")).mapInArrow(lean("quality", _stats), f"_id {kind}, stats array<double>"), "stats")
    model = fit(stats, labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("label")), folds, fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                s = np.clip(model.score(_matrix(batch.column(1))), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["_id", "score", "predicted"])

    out = stats.mapInArrow(lean("quality", run), f"_id {kind}, score double, predicted int")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id"), folds, fold).alias("held_out"), "score", "predicted")
