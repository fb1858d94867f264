"""Vectorised work on the words of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; the table of powers has as many entries.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: np.ndarray | None = None


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or one row."""
    _, at = utf8(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of each text's first word, with the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~_SPACE[data]
    edge = np.ones(n + 1, bool)  # may a word start here / end before here
    edge[1:n] = ~word[:-1]
    edge[at[at < n]] = True
    starts = np.flatnonzero(word & edge[:n])
    edge = np.ones(n + 1, bool)
    edge[:n] = ~word
    edge[at] = True
    ends = np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _table() -> np.ndarray:
    global _powers
    if _powers is None:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.full(CHUNK + 1, _BASE, np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial over the bytes."""
    out = np.empty(len(starts), np.uint64)
    power, i = _table(), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = int(starts[i])
            j = int(np.searchsorted(ends, lo + CHUNK, "right"))
            if j <= i:  # a word longer than a chunk
                out[i] = xxhash.xxh64_intdigest(data[lo : ends[i]].tobytes(), 7)
                i += 1
                continue
            part = data[lo : ends[j - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power[: len(part)], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix64((sums[e] - sums[s]) * power[CHUNK - s])
            i = j
    return out


def rolling(w: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hash of each n consecutive words, by doubling; entry i is for words i to i + n - 1."""
    with np.errstate(over="ignore"):
        done, total, block, length, step = 0, None, w, 1, np.uint64(base)
        while True:
            if n & length:
                if total is None:
                    total, done, scale = block, length, step
                else:
                    m = len(block) - done
                    total = total[:m] + scale * block[done : done + m] if m > 0 else block[:0]
                    done, scale = done + length, scale * step
            if done == n:
                return mix64(total[: max(0, len(w) - n + 1)].copy())
            m = len(block) - length
            if m <= 0:
                return w[:0]
            block, step, length = block[:m] + step * block[length : length + m], step * step, 2 * length


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each n consecutive entries."""
    if len(x) < n:
        return x[:0]
    length = 1
    while 2 * length <= n:
        x = best(x[: len(x) - length], x[length:])
        length *= 2
    rest = n - length
    return best(x[: len(x) - rest], x[rest:]) if rest else x
