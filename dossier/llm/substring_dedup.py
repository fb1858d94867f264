"""Substring dedup: a count-min prefilter, then exact groups of the windows estimated repeated."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.memory import lean
from dossier.llm.words import mix64, rolling, slices, sliding, spans, utf8, word_hashes
from dossier.session import materialise, partitions

#: Sketch rows, and cells of each for each expected entry.
DEPTH, CELLS = 2, 4
PAGE = 1 << 16
#: The merged sketch's repeated cells may be broadcast up to so many bytes; beyond it they are joined.
BROADCAST_BYTES = 64 << 20
FLUSH = 1 << 20
#: An anchor in so many places is hot: its windows are dealt by their own hashes, so no shard gets them all.
HOT = 1 << 16
_BASE_A, _BASE_B, _BASE_G = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F


def _batch(column: pa.Array, width: int) -> tuple[np.ndarray, ...]:
    """For the texts of a column: word hashes, first word of each text, the valid window starts, each window's anchor.

    The anchor of a window is the least hash of the runs of g words inside it (g about half the
    width). Equal windows have equal anchors, at the same place inside them.
    """
    data, at = utf8(column)
    starts, ends, first = spans(data, at)
    w = word_hashes(data, starts, ends)
    valid = np.zeros(max(0, len(w) - width + 1), bool)
    for i in range(len(first) - 1):
        if first[i + 1] - first[i] >= width:
            valid[first[i] : first[i + 1] - width + 1] = True
    if not valid.any():
        return w, first, valid, np.zeros(0, np.uint64), np.zeros(0, bool)
    g = (width + 1) // 2
    runs = rolling(w, g, _BASE_G) | np.uint64(1)
    span = width - g + 1
    anchor = sliding(runs, span, np.minimum)[: len(valid)]
    # A run is chosen if it is the anchor of a valid window that holds it.
    held = np.zeros(len(runs) + span - 1, np.uint64)
    held[span - 1 : span - 1 + len(valid)] = np.where(valid, anchor, np.uint64(0))
    chosen = sliding(held, span, np.maximum)[: len(runs)] == runs
    return w, first, valid, anchor, runs[chosen]


def _cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each anchor in each sketch row; rows lie one after another."""
    shift = np.uint64(64 - bits)
    out, h = [], anchor
    for row in range(DEPTH):
        h = mix64(h + np.uint64(0x632BE59BD9B4E019))
        out.append((h >> shift) + np.uint64(row << bits))
    return out


def _sketch(bits: int, width: int):
    """Partition sketches: for each page of cells those seen once, and those seen more often with their counts."""

    def pages(cells: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(cells), return_counts=True)
        page, start = np.unique(cell >> np.uint64(16), return_index=True)
        bound = [*start.tolist(), len(cell)]
        low = (cell & np.uint64(PAGE - 1)).astype("<u2")
        once, more, times = [], [], []
        for a, b in zip(bound, bound[1:], strict=False):
            again = n[a:b] > 1
            once.append(low[a:b][~again].tobytes())
            more.append(low[a:b][again].tobytes())
            times.append(np.minimum(n[a:b][again], 65535).astype("<u2").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(page.astype(np.int64)), *[pa.array(x, pa.binary()) for x in (once, more, times)]], ["page", "once", "more", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i, j in slices(b.column(0)):
                chosen = _batch(b.column(0).slice(i, j - i), width)[4]
                if len(chosen):
                    held += _cells(chosen, bits)
                    n += DEPTH * len(chosen)
                if n > FLUSH:
                    yield pages(held)
                    held, n = [], 0
        if n:
            yield pages(held)

    return run


def _merge(key, table):
    """A page's cells whose counts, summed over partitions, reach two, and those that reach HOT."""
    count = np.zeros(PAGE, np.int64)
    for once, more, times in zip(table.column("once"), table.column("more"), table.column("times"), strict=True):
        count[np.frombuffer(once.as_buffer(), "<u2")] += 1
        count[np.frombuffer(more.as_buffer(), "<u2")] += np.frombuffer(times.as_buffer(), "<u2")
    cells = [pa.array([np.flatnonzero(count >= least).astype("<u2").tobytes()], pa.binary()) for least in (2, HOT)]
    return pa.table({"page": [key[0].as_py()], "cells": cells[0], "hot": cells[1]})


class _Repeated:
    """Membership in the merged sketch, as bitmaps (of repeated and of hot cells) built once in each worker."""

    def __init__(self, bits: int, pages: list[tuple[int, bytes, bytes]]):
        self.bits = bits
        self.maps = [self._map(pages, k) for k in (1, 2)]

    def _map(self, pages: list[tuple[int, bytes, bytes]], k: int) -> np.ndarray | None:
        if not any(p[k] for p in pages):
            return None
        out = np.zeros((DEPTH << self.bits) // 8 + 1, np.uint8)
        for p in pages:
            at = np.frombuffer(p[k], "<u2").astype(np.int64) + p[0] * PAGE
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    def __call__(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it repeated, is it hot) of each anchor."""
        cells, out = _cells(anchor, self.bits), []
        for bitmap in self.maps:
            hit = np.full(len(anchor), bitmap is not None)
            for cell in cells if bitmap is not None else ():
                hit &= (bitmap[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
            out.append(hit)
        return out[0], out[1]


def _candidates(width: int, bits: int, shards: int, repeated):
    """Windows estimated repeated, dealt into shards by their anchor, equal ones of a flush as one.

    Equal windows have equal anchors, and neighbours mostly the same, so a document meets few shards.
    Windows of a hot anchor are dealt by their own hash; as hot is what the merged sketch says, equal
    windows still meet.

    Of windows that a flush holds more than once, one goes to its shard with the count 2; all their
    places are known to be repeated and go to the shard of their document.
    """
    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b, doc, pos = (np.concatenate([h[k] for h in held]) for k in range(4))
        keys, shard = np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
        order = np.lexsort((b, a))
        a, b, doc, pos, shard = a[order], b[order], doc[order], pos[order], shard[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(a)))
        known = np.repeat(n > 1, n)
        a, b, d, p, n, shard = a[at], b[at], doc[at], pos[at], np.minimum(n, 2).astype(np.uint8), shard[at]
        order = np.argsort(shard, kind="stable")
        a, b, d, p, n, shard = a[order], b[order], d[order], p[order], n[order], shard[order]
        cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
        rows = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            ids, at = np.unique(d[i:j], return_inverse=True)
            rows.append((int(shard[i]), a[i:j].tobytes(), b[i:j].tobytes(), n[i:j].tobytes(), at.astype("<u4").tobytes(), p[i:j].tobytes(), keys[ids].tobytes()))
        if known.any():
            d, p = doc[known], pos[known]
            order = np.argsort(d, kind="stable")
            d, p = d[order], p[order]
            cuts = [*np.flatnonzero(np.diff(d, prepend=-1)).tolist(), len(d)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                key = keys[d[i]]
                rows.append((int(mix64(key[:1])[0] % np.uint64(shards)), b"", b"", b"", b"", p[i:j].tobytes(), key.tobytes()))
        names = ["shard", "a", "b", "n", "doc", "pos", "keys"]
        kinds = [pa.int64(), *[pa.binary()] * 6]
        for i in range(0, len(rows), 4096):
            part = rows[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], kinds[k]) for k in range(7)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, docs = [], 0, 0
        for batch in batches:
            for i, j in slices(batch.column(2)):
                w, first, valid, anchor, _ = _batch(batch.column(2).slice(i, j - i), width)
                if not valid.any():
                    continue
                again, hot = repeated(anchor) if repeated is not None else _in_rows(batch, i, j, first, anchor, bits)
                at = np.flatnonzero(valid & again)
                if not len(at):
                    continue
                a = rolling(w, width, _BASE_A)[at]
                b = (rolling(w, width, _BASE_B)[at] >> np.uint64(32)).astype("<u4")
                doc = np.searchsorted(first, at, "right") - 1
                key = np.stack([np.asarray(batch.column(k).slice(i, j - i)).astype(np.int64) for k in (0, 1)], axis=1).view(np.uint64)
                shard = mix64(np.where(hot[at], a, anchor[at])) % np.uint64(shards)
                held.append((a, b, doc + docs, (at - first[doc]).astype("<u4"), key, shard.astype(np.int64)))
                docs += j - i
                n += len(at)
                if n > FLUSH:
                    yield from flush(held)
                    held, n, docs = [], 0, 0
        if n:
            yield from flush(held)

    return run


def _in_rows(batch: pa.RecordBatch, i: int, j: int, first: np.ndarray, anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As _Repeated, from each text's own lists of repeated and of hot cells."""
    out = []
    for column in (batch.column(3).slice(i, j - i), batch.column(4).slice(i, j - i)):
        hit = np.zeros(len(anchor), bool)
        for k in range(len(first) - 1):
            lo, hi = int(first[k]), min(int(first[k + 1]), len(anchor))
            if lo < hi and column[k].is_valid and len(column[k].values):
                cells = np.asarray(column[k].values).astype(np.uint64)
                part = np.ones(hi - lo, bool)
                for cell in _cells(anchor[lo:hi], bits):
                    part &= np.isin(cell, cells)
                hit[lo:hi] = part
        out.append(hit)
    return out[0], out[1]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups the windows of each shard; those of a group of two or more are repeated."""
    held: dict[int, list] = {}

    def rows(key: np.ndarray, pos: list[bytes]) -> pa.RecordBatch:
        key = np.ascontiguousarray(key).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(pos, pa.binary())], ["k1", "k2", "pos"])

    for batch in batches:
        shard, a, b, n, doc, pos, keys = (batch.column(k) for k in range(7))
        through = []
        for i in range(batch.num_rows):
            if not len(a[i].as_buffer()):
                through.append((np.frombuffer(keys[i].as_py(), np.uint64), pos[i].as_py()))
            else:
                held.setdefault(shard[i].as_py(), []).append([x[i].as_py() for x in (a, b, n, doc, pos, keys)])
        if through:
            yield rows(np.stack([k for k, _ in through]), [p for _, p in through])
    for shard in list(held):
        part = held.pop(shard)
        a, b, n, doc, pos = (np.concatenate([np.frombuffer(r[k], t) for r in part]) for k, t in enumerate(("<u8", "<u4", "u1", "<u4", "<u4")))
        keys = [np.frombuffer(r[5], np.uint64).reshape(-1, 2) for r in part]
        base = np.repeat(np.cumsum([0, *[len(k) for k in keys[:-1]]]), [len(r[2]) for r in part])
        keys, doc = np.concatenate(keys), doc + base
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(n[order].astype(np.int64), at)
        again = order[np.repeat(total > 1, np.diff(np.append(at, len(a))))]
        if not len(again):
            continue
        d, p = doc[again], pos[again]
        order = np.argsort(d, kind="stable")
        d, p = d[order], p[order]
        cuts = [*np.flatnonzero(np.diff(d, prepend=-1)).tolist(), len(d)]
        yield rows(keys[d[cuts[:-1]]], [p[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)])


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                words = text.encode().split() if text else []
                drop = np.zeros(len(words) + 1, np.int64)
                for p in batch.column(2)[i].values or []:
                    at = np.frombuffer(p.as_buffer(), "<u4").astype(np.int64)
                    np.add.at(drop, at, 1)
                    np.add.at(drop, at + width, -1)
                out = np.cumsum(drop[:-1]) > 0
                total.append(len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if gone[-1] else words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept (the words left, joined by a space).

    A word goes if a window of width words covers it whose word sequence starts elsewhere too.
    1. Each partition sketches its windows' anchors in a count-min sketch, as wide as the corpus asks;
       partition sketches are merged page by page. As every occurrence of a window brings an occurrence
       of its anchor, a window's estimate is never below its count.
    2. Windows estimated at two or more are grouped exactly, by a 96-bit hash of their words; a window
       that is common everywhere costs a row for each flush of a task, not one for each occurrence.
    3. Repeated places go back to their documents, whose words are then dropped.
    Null and empty texts have no words. Repeated rows are each other's copies. A text of any length is
    one document. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    base = docs.select(ident.alias("_id"), F.xxhash64(F.lit("id"), ident.cast("string")).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("_text"))
    size = base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    # Chosen anchors: 2 of each (width - g + 2) words, of about six bytes each.
    expected = size / 6 * 2 / ((width + 1) // 2 + 1)
    bits = max(16, math.ceil(math.log2(max(2.0, CELLS * expected))))
    found = base.select("_text").mapInArrow(lean("repeats", _sketch(bits, width)), "page long, once binary, more binary, times binary")
    merged = materialise(found.groupBy("page").applyInArrow(_merge, "page long, cells binary, hot binary").where("length(cells) > 0"), "sketch")
    if (merged.agg(F.sum(F.length("cells") + 8)).first()[0] or 0) <= broadcast_bytes and (DEPTH << bits) // 8 <= broadcast_bytes:
        shared = spark.sparkContext.broadcast([(r[0], bytes(r[1]), bytes(r[2])) for r in merged.collect()])
        asked, test = base.select("k1", "k2", "_text"), _Lazy(bits, shared)
    else:
        asked, test = _asked_by_join(base, merged, bits, width), None
    shards = 8 * max(partitions(spark), math.ceil(size / 6 * 20 / (32 << 20)))
    kinds = "shard long, a binary, b binary, n binary, doc binary, pos binary, keys binary"
    windows = asked.mapInArrow(lean("repeats", _candidates(width, bits, shards, test)), kinds).repartition(shards // 8, "shard")
    places = windows.mapInArrow(lean("repeats", _exact), "k1 long, k2 long, pos binary")
    flags = places.groupBy("k1", "k2").agg(F.collect_set("pos").alias("pos"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = base.join(flags, ["k1", "k2"], "left").select("_id", "_text", "pos")
    return joined.mapInArrow(lean("repeats", _remove(width)), f"_id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("_id", id_col)


class _Lazy:
    """The broadcast sketch, opened in the worker that first asks."""

    def __init__(self, bits: int, shared):
        self.bits, self.shared, self.test = bits, shared, None

    def __call__(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.test is None:
            self.test = _Repeated(self.bits, self.shared.value)
        return self.test(anchor)


def _asked_by_join(base: DataFrame, merged: DataFrame, bits: int, width: int) -> DataFrame:
    """base with each text's own repeated cells, by a join on cells instead of a broadcast."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cells = [], []
            for i in range(batch.num_rows):
                chosen = _batch(batch.column(2).slice(i, 1), width)[4]
                if len(chosen):
                    cells.append(np.unique(np.concatenate(_cells(chosen, bits))).astype(np.int64))
                    keys.append(np.full(len(cells[-1]), i))
            if cells:
                at = pa.array(np.concatenate(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(cells))], ["k1", "k2", "cell"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, hot = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u2").astype(np.int64) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(at + batch.column(0)[i].as_py() * PAGE), pa.array(np.isin(at, hot))], ["cell", "hot"])

    entries = base.select("k1", "k2", "_text").mapInArrow(lean("repeats", own), "k1 long, k2 long, cell long")
    cells = merged.select("page", "cells", "hot").mapInArrow(lean("repeats", spread), "cell long, hot boolean")
    hits = entries.join(cells, "cell").groupBy("k1", "k2").agg(F.collect_set("cell").alias("cells"), F.collect_set(F.when(F.col("hot"), F.col("cell"))).alias("hot"))
    return base.join(hits, ["k1", "k2"], "left").select("k1", "k2", "_text", "cells", "hot")
