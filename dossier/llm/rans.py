"""A static range asymmetric numeral system over token ids, with independent interleaved blocks.

A table gives every id that occurs a share of 2^SCALE, by its count in the corpus; all blocks share
it. In a block, id i belongs to lane i mod lanes, and all lanes advance together; their states are
64 bits wide and put out 32 bits at a time, into one stream in the order in which a decoder asks.
Every EVERY steps a checkpoint holds the lanes' states and the place in the stream, so a block can
be decoded from any of them, and parts of it in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SCALE = 20
EVERY = 256
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIIII")
MAGIC = b"RNS1"


@dataclass
class Table:
    """Frequencies (summing to 2^SCALE) of ids 0 to n - 1."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = self.freq.astype(np.uint64)
        self.cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1].astype(np.uint64)])
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Shares in proportion to counts, at least 1 for an id that occurs; the largest take up the rest."""
        used = np.flatnonzero(counts)
        freq = np.zeros(len(counts), np.int64)
        if not len(used):
            freq[0] = 1 << SCALE
            return cls(freq)
        if len(used) > 1 << (SCALE - 1):
            raise ValueError(f"{len(used)} different ids are too many for a table of 2^{SCALE}")
        total = int(counts.sum())
        freq[used] = np.maximum(1, (counts[used].astype(object) * (1 << SCALE) // total).astype(np.int64))
        order = used[np.argsort(-freq[used], kind="stable")]
        rest = (1 << SCALE) - int(freq.sum())
        for i in order:
            if rest >= 0:
                freq[i] += rest
                break
            take = min(int(freq[i]) - 1, -rest)
            freq[i] -= take
            rest += take
        return cls(freq)

    def to_bytes(self) -> bytes:
        raw = self.freq.astype("<u4").tobytes()
        return struct.pack("<4sII", b"RNST", len(self.freq), zlib.crc32(raw)) + raw

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        magic, n, crc = struct.unpack_from("<4sII", data)
        raw = data[12:]
        if magic != b"RNST" or len(raw) != 4 * n or zlib.crc32(raw) != crc:
            raise ValueError("not a sound frequency table")
        return cls(np.frombuffer(raw, "<u4"))


def lanes_for(n: int) -> int:
    """Lanes of a block of n ids: many, but few enough that their states cost little."""
    lanes = 1
    while lanes < 2048 and lanes * 512 < n:
        lanes *= 2
    return lanes


def encode(ids: np.ndarray, table: Table) -> bytes:
    """A block: header, checkpoints, stream; with a checksum of the ids and one of all that follows the header."""
    n, lanes = len(ids), lanes_for(len(ids))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out: list[np.ndarray] = []
    emitted, marks = 0, []
    scale, wide, limit = np.uint64(SCALE), np.uint64(32), np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        f, y = table.freq[s], x[: len(s)]
        if not f.all():
            raise ValueError("an id is not in the frequency table")
        over = y >= (f << limit)
        if over.any():
            out.append(y[over].astype("<u4"))
            emitted += len(out[-1])
            y = np.where(over, y >> wide, y)
        q = y // f
        x[: len(s)] = (q << scale) + (y - q * f) + table.cum[s]
        if t % EVERY == 0:
            marks.append((emitted, x.astype("<u8").tobytes()))
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    body = b"".join(struct.pack("<I", emitted - e) + states for e, states in reversed(marks)) + stream.tobytes()
    ids4 = np.ascontiguousarray(ids, "<u4")
    return _HEAD.pack(MAGIC, n, lanes, EVERY, len(marks), len(stream), zlib.crc32(ids4), zlib.crc32(body)) + body


def _open(block: bytes) -> tuple:
    magic, n, lanes, every, marks, words, crc_ids, crc_body = _HEAD.unpack_from(block)
    body = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or len(body) != marks * (4 + 8 * lanes) + 4 * words or zlib.crc32(body) != crc_body:
        raise ValueError("a block is damaged")
    return n, lanes, every, marks, np.frombuffer(body[marks * (4 + 8 * lanes) :], "<u4"), crc_ids, body


def decode_from(block: bytes, table: Table, mark: int, opened: tuple | None = None) -> np.ndarray:
    """The ids from one checkpoint to the next."""
    n, lanes, every, marks, stream, _, body = opened or _open(block)
    at = mark * (4 + 8 * lanes)
    p = struct.unpack_from("<I", body, at)[0]
    x = np.frombuffer(body[at + 4 : at + 4 + 8 * lanes], "<u8").astype(np.uint64)
    lo, hi = mark * every * lanes, min(n, (mark + 1) * every * lanes)
    out = np.empty(hi - lo, np.uint32)
    scale, wide, mask = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1)
    for i in range(0, hi - lo, lanes):
        k = min(lanes, hi - lo - i)
        y = x[:k]
        slot = y & mask
        s = table.symbol[slot.astype(np.int64)]
        out[i : i + k] = s
        y = table.freq[s] * (y >> scale) + slot - table.cum[s]
        under = np.flatnonzero(y < LOW)
        if len(under):
            y[under] = (y[under] << wide) | stream[p : p + len(under)]
            p += len(under)
        x[:k] = y
    return out


def decode_parts(block: bytes, table: Table) -> Iterator[np.ndarray]:
    """The ids of a block, from checkpoint to checkpoint; after the last they are held against their checksum."""
    opened, crc = _open(block), 0
    for mark in range(opened[3]):
        ids = decode_from(block, table, mark, opened)
        crc = zlib.crc32(np.ascontiguousarray(ids, "<u4"), crc)
        yield ids
    if crc != opened[5]:
        raise ValueError("a block does not decode to what was encoded")


def decode(block: bytes, table: Table) -> np.ndarray:
    """All ids of a block, checked against their checksum."""
    return np.concatenate([np.zeros(0, np.uint32), *decode_parts(block, table)])
