"""Language ID: a bidirectional gated recurrent network over bytes, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.memory import lean
from dossier.llm.words import slices, utf8

#: Bytes of a window; a text is cut into windows, all of them read, each from a state of zero.
WINDOW = 128
HIDDEN = 12
#: The sample that the network learns from: documents in all, windows of each, and training steps.
TRAIN_DOCS, TRAIN_WINDOWS, STEPS, BATCH = 2400, 4, 260, 192
ROWS = 1024
UNKNOWN = "und"


@dataclass
class Network:
    """Weights; *_x: gates (update, reset, new) by byte, *_h: by hidden state; out: classes by both states."""

    langs: list[str]
    weights: dict[str, np.ndarray]


def _init(n: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, f = HIDDEN, np.float32
    w = {}
    for d in ("fw", "bw"):
        w[f"{d}_x"] = (rng.normal(size=(3 * h, 256)) * 0.3).astype(f)
        w[f"{d}_h"] = (rng.normal(size=(3 * h, h)) * 0.35).astype(f)
        w[f"{d}_x"][:h] += f(0.7)  # keep the state at first
    w["out"] = (rng.normal(size=(n, 2 * h)) * 0.3).astype(f)
    w["bias"] = np.zeros((n, 1), f)
    return w


def _direction(x: np.ndarray, h: np.ndarray, text: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction over text (steps, rows): (steps, hidden, rows). keep gets what training needs."""
    k, rows = h.shape[1], text.shape[1]
    state = np.zeros((k, rows), np.float32)
    out = np.empty((len(text), k, rows), np.float32)
    g, u = np.empty((3 * k, rows), np.float32), np.empty((3 * k, rows), np.float32)
    for t in range(len(text)):
        np.take(x, text[t], axis=1, out=g, mode="clip")
        np.matmul(h, state, out=u)
        gates = g[: 2 * k]
        gates += u[: 2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        un = u[2 * k :]
        new = g[2 * k :] + gates[k:] * un
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((gates.copy(), un.copy(), new.copy(), state.copy()))
        state = new + gates[:k] * (state - new)
        out[t] = state
    return out


def _backward(h: np.ndarray, x_shape: tuple, text: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the weights by byte and by state."""
    k = h.shape[1]
    dx, dh, carry = np.zeros(x_shape, np.float32).T.copy(), np.zeros_like(h), np.zeros_like(grad[0])
    for t in range(len(text) - 1, -1, -1):
        gates, un, new, before = kept[t]
        z, r = gates[:k], gates[k:]
        d = grad[t] + carry
        dnew = d * (1 - z) * (1 - new * new)
        dz = d * (before - new) * z * (1 - z)
        dr = dnew * un * r * (1 - r)
        pre = np.concatenate([dz, dr, dnew])
        by_state = np.concatenate([dz, dr, dnew * r])
        np.add.at(dx, text[t], pre.T)
        dh += by_state @ before.T
        carry = d * z + h.T @ by_state
    return dx.T, dh


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def train(windows: np.ndarray, mask: np.ndarray, label: np.ndarray, langs: list[str], seed: int = 7) -> Network:
    """Adam on the mean cross entropy of every position's label; windows is (rows, WINDOW) of bytes."""
    rng = np.random.default_rng(seed)
    w = _init(len(langs), rng)
    if len(langs) < 2 or not len(windows):
        return Network(langs, w)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    k = HIDDEN
    for step in range(1, STEPS + 1):
        at = rng.integers(0, len(windows), BATCH)
        text, m = windows[at].T, mask[at].T.astype(np.float32)
        kept_f, kept_b = [], []
        hf = _direction(w["fw_x"], w["fw_h"], text, kept_f)
        hb = _direction(w["bw_x"], w["bw_h"], text[::-1], kept_b)[::-1]
        both = np.concatenate([hf, hb], axis=1)
        p = _softmax(w["out"] @ both + w["bias"], 1)
        p[:, label[at], np.arange(BATCH)] -= 1
        p *= (m / m.sum())[:, None, :]
        g = {"out": np.einsum("tcr,thr->ch", p, both, optimize=True), "bias": p.sum(axis=(0, 2))[:, None]}
        back = w["out"].T @ p
        g["fw_x"], g["fw_h"] = _backward(w["fw_h"], w["fw_x"].shape, text, kept_f, back[:, :k])
        g["bw_x"], g["bw_h"] = _backward(w["bw_h"], w["bw_x"].shape, text[::-1], kept_b, back[::-1, k:])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for name, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            first[name] = 0.9 * first[name] + 0.1 * v
            second[name] = 0.99 * second[name] + 0.01 * v * v
            w[name] = (w[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(langs, w)


def _cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts: (bytes padded with spaces, used positions, text of each)."""
    n = np.diff(at)
    count = -(-n // WINDOW)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = at[doc] + nth * WINDOW
    where = start[:, None] + np.arange(WINDOW)
    used = where < at[doc + 1][:, None]
    padded = np.append(data, np.full(WINDOW, 32, np.uint8))
    return np.where(used, padded[np.minimum(where, len(padded) - 1)], 32).astype(np.uint8), used, doc


def pooled(net: Network, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean over all positions of each text of the position's class probabilities: (texts, classes)."""
    w, k = net.weights, HIDDEN
    out = np.zeros((len(at) - 1, len(net.langs)), np.float64)
    windows, used, doc = _cut(data, at)
    for i in range(0, len(windows), ROWS):
        text = np.ascontiguousarray(windows[i : i + ROWS].T)
        m = used[i : i + ROWS].T.astype(np.float32)
        hf = _direction(w["fw_x"], w["fw_h"], text)
        hb = _direction(w["bw_x"], w["bw_h"], text[::-1])[::-1]
        total = np.zeros((len(net.langs), text.shape[1]), np.float32)
        for t in range(WINDOW):
            e = np.exp(w["out"][:, :k] @ hf[t] + w["out"][:, k:] @ hb[t] + w["bias"])
            e *= m[t] / e.sum(axis=0)
            total += e
        np.add.at(out, doc[i : i + ROWS], total.T)
    return out / np.maximum(1, np.diff(at))[:, None]


def held_out(ident: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold; a null id is in no fold."""
    return F.coalesce(F.crc32(F.encode(ident.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> Network:
    """A network from a bounded sample of the labelled documents outside the fold.

    TRAIN_DOCS documents at most, shared evenly among the languages (all of a language with fewer),
    drawn by a hash of id and text; of each up to TRAIN_WINDOWS windows, at places anywhere in the
    text, drawn by a hash too. A row that is there several times is drawn once. Of more
    languages than TRAIN_DOCS those with most documents are learned. Nothing else is gathered.
    """
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    known = docs.where(lang.isNotNull() & text.isNotNull() & ~held_out(F.col(f"`{id_col}`"), folds, fold))
    # The draw is by id and text: rows that share an id are drawn apart. It has 63 bits, so no count is too large for a share.
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col(f"`{id_col}`").cast("string"), text), 1)
    seen = known.select(lang.cast("string").alias("l"), draw.alias("d"))
    # As each language needs a document, there are TRAIN_DOCS of them at most: what is gathered has a fixed size.
    top = seen.groupBy("l").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "l").limit(TRAIN_DOCS).collect()
    counts = {r[0]: r[1] for r in top}
    langs = sorted(counts)
    if not langs:
        return Network([], _init(1, np.random.default_rng(7)))
    want = max(1, TRAIN_DOCS // len(langs))
    # Twice the share is let through, and of these the least draws count, so all languages reach their number.
    bound = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1 << 63, (2 * want + 20) * (1 << 63) // counts[k]) - 1))])
    picked = known.withColumn("_draw", draw).where(F.col("_draw") <= F.coalesce(F.element_at(bound, lang.cast("string")), F.lit(-1).cast("long")))
    place = [F.pmod(F.xxhash64(F.lit(i), "_draw"), F.greatest(F.lit(1), F.length(text) - WINDOW + 1)) + 1 for i in range(TRAIN_WINDOWS)]
    rows = picked.select(
        F.col("_draw").alias("d"), lang.cast("string").alias("l"),
        F.array_distinct(F.array(*[F.substring(text, p.cast("int"), F.lit(WINDOW)) for p in place])).alias("w"),
    ).distinct()
    nth = F.row_number().over(Window.partitionBy("l").orderBy("d", "w"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= want).orderBy("d", "l").collect()
    samples = [(t.encode()[:WINDOW], langs.index(r["l"])) for r in rows for t in sorted(r["w"]) if t]
    windows = np.full((len(samples), WINDOW), 32, np.uint8)
    mask = np.zeros((len(samples), WINDOW), bool)
    for k, (t, _) in enumerate(samples):
        windows[k, : len(t)] = np.frombuffer(t, np.uint8)
        mask[k, : len(t)] = True
    # Languages count alike however many windows each has: draw rows by language.
    label = np.array([x for _, x in samples], np.int64)
    order = np.concatenate([np.resize(np.flatnonzero(label == c), max(np.bincount(label))) for c in range(len(langs)) if (label == c).any()]) if len(label) else label
    return train(windows[order], mask[order], label[order], langs)


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred and score of every row, with the columns of carry.

    Every byte of a text is labelled; a document's probabilities are the mean over its positions.
    Null texts and texts without a letter are `und` with score 0, as is all if no language was learned.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    extra = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                part = batch.slice(i, j - i)
                letters = np.asarray(part.column(0).to_pandas(), bool) & bool(model.langs)
                best, score = np.zeros(len(part), np.int64), np.zeros(len(part))
                if len(model.langs) == 1:
                    score[:] = 1.0
                elif letters.any():
                    p = pooled(model, *utf8(part.column(1)))
                    best, score = p.argmax(axis=1), p.max(axis=1)
                langs = [model.langs[b] if x else UNKNOWN for b, x in zip(best.tolist(), letters.tolist(), strict=True)]
                score = np.where(letters, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(langs, pa.string()), pa.array(score)], [f"c{k}" for k in range(extra + 1)] + ["lang_pred", "score"])

    names = [id_col, *carry]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text_in"), *[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)])
    kinds = [f"c{k} {docs.schema[n].dataType.simpleString()}" for k, n in enumerate(names)]
    out = rows.mapInArrow(lean("language", run), ", ".join([*kinds, "lang_pred string", "score double"]))
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], "lang_pred", "score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    Every byte of every text is read. Null texts and texts without a letter are `und` with score 0;
    null languages teach nothing; a null id is in no fold. Of equal probabilities the language first
    in order wins. Repeated rows are predicted each; extra columns are ignored; an empty table gives
    an empty result.
    """
    net = learn(docs, id_col, text_col, lang_col, folds, fold)
    return predict(docs, net, id_col, text_col).select(id_col, held_out(F.col(f"`{id_col}`"), folds, fold).alias("held_out"), "lang_pred", "score")
