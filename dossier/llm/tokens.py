"""Token ids of Arrow text columns by the tokenizers library, each different piece encoded once."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from dossier.llm import memory as _memory
from dossier.llm.words import mix64, spans, utf8, word_hashes

#: Pieces a worker remembers; beyond it the memory starts afresh.
MEMORY = 1_500_000
SLOTS = 1 << 22
_SHIFT = np.uint64(64 - 22)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_open: dict[str, object] = {}
_memories: dict[tuple, object] = {}
_memory.cache(_memories.clear)
_memory.cache(_open.clear)


def tokenizer(path: str):
    """The library's tokenizer of a .json file, without truncation or padding, opened once in each process."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _open[path] = tok
    return _open[path]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _kind(tok) -> tuple[bool, bool, list[bytes]]:
    """Whether pre-tokens part letters from marks, whether case is dropped, and the added tokens."""
    spec = json.loads(tok.to_str())
    pre = json.dumps(spec["pre_tokenizer"])
    parts = "ByteLevel" in pre and ('"use_regex": true' in pre or "[^\\\\s\\\\p{L}\\\\p{N}]+" in pre)
    return parts, "Lowercase" in json.dumps(spec["normalizer"]), [x["content"].encode() for x in spec["added_tokens"]]


def _inner(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places between a letter (ASCII, U+00C0 to U+00FF) and an ASCII mark other than an apostrophe: always ends of a pre-token."""
    cut = np.zeros(len(data), bool)
    begins, mark = _LETTER[data], _MARK[data]
    done = begins.copy()
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    begins[lead], done[lead + 1] = True, True
    cut[1:] = (done[:-1] & mark[1:]) | (mark[:-1] & begins[1:])
    cut[at[at < len(data)]] = False
    return cut


def _pieces_spaced(data: np.ndarray, at: np.ndarray, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of texts before each ASCII space that follows something else, and inside words.

    A byte-level pre-token has white space at its start only, or is all white space, and matching goes
    on from its end without looking back; so such a place is always a boundary, and the pieces'
    tokens are the text's. What may be the end of a wider space is not taken for something else.
    """
    n = len(data)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    unsure = white.copy()
    unsure[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    unsure[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & ((data[1:-1] == 0x9A) | (data[1:-1] == 0x80) | (data[1:-1] == 0x81)) & (data[2:] >= 0x80)
    cut = np.zeros(n, bool)
    cut[1:] = white[1:] & ~unsure[:-1]
    if inner:
        cut |= _inner(data, at)
    cut[at[at < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


def _pieces_bare(data: np.ndarray, at: np.ndarray, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words, for a tokenizer that drops white space and looks at each word alone, and parts of words."""
    starts, ends, _ = spans(data, at)
    if inner:
        cut = np.append(_inner(data, at), False)
        both = []
        for edges in (starts, ends):
            flags = cut.copy()
            flags[edges] = True
            both.append(np.flatnonzero(flags))
        starts, ends = both
    return starts, ends


class _Memory:
    """Ids of pieces, held one after another, and an open hash table of the pieces.

    A piece is known by a 64-bit hash of its bytes and by 32 bits of its length, first and last eight bytes.
    """

    def __init__(self, tok, ids: bool):
        self.tok, self.ids = tok, ids
        self.parts, self.caseless, self.special = _kind(tok)
        self.between = _separator(tok) if ids and self.parts else None
        self.kind = np.uint16 if max(tok.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        self.clear()

    life = 0

    def clear(self):
        self.life += 1
        self.key, self.again, self.entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.int32)
        self.known = 0
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.store, self.used = np.zeros(4096, self.kind), 0

    def _probe(self, h: np.ndarray, again: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries (-1 if unknown) and the slots where the search ended."""
        slot = (h >> _SHIFT).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        left = at
        while len(left):
            s = slot[left]
            k = self.key[s]
            hit = (k == h[left]) & (self.again[s] == again[left])
            out[left[hit]] = self.entry[s[hit]]
            left = left[~hit & (k != 0)]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return out, slot

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each piece's)."""
        if self.between is None or any("7" in p for p in pieces):
            done = self.tok.encode_batch_fast(pieces, add_special_tokens=False)
            lengths = np.fromiter(map(len, done), np.int64, len(done))
            return np.fromiter((x for e in done for x in e.ids), np.uint32, int(lengths.sum())) if self.ids else lengths[:0].astype(np.uint32), lengths
        done = self.tok.encode_batch_fast([" 7 ".join(pieces[i : i + 256]) + " 7" for i in range(0, len(pieces), 256)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in done])
        mark = ids == self.between
        return ids[~mark], np.diff(np.flatnonzero(mark), prepend=-1) - 1

    def _learn(self, pieces: list[str], h: np.ndarray, again: np.ndarray) -> None:
        at = self.known
        if at + len(pieces) > len(self.start):
            grow = max(len(self.start) // 2, len(pieces))
            self.start, self.length = np.append(self.start, np.zeros(grow, np.int64)), np.append(self.length, np.zeros(grow, np.int32))
        # Pieces with the separator's digit are encoded apart.
        order = np.argsort(np.fromiter(("7" in p for p in pieces), bool, len(pieces)), kind="stable") if self.between is not None else np.arange(len(pieces))
        pieces, h, again = [pieces[k] for k in order.tolist()], h[order], again[order]
        for i in range(0, len(pieces), 4096):
            ids, lengths = self._encode(pieces[i : i + 4096])
            self.length[at + i : at + i + len(lengths)] = lengths
            if self.ids:
                if self.used + len(ids) > len(self.store):
                    self.store = np.append(self.store, np.zeros(max(len(self.store) // 2, len(ids)), self.kind))
                self.start[at + i : at + i + len(lengths)] = self.used + np.cumsum(lengths) - lengths
                self.store[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
        todo = np.arange(len(pieces))
        while len(todo):
            slot = self._probe(h, again, todo)[1][todo]
            _, one = np.unique(slot, return_index=True)
            s = slot[one]
            self.key[s], self.again[s], self.entry[s] = h[todo[one]], again[todo[one]], at + todo[one]
            todo = np.delete(todo, one)
        self.known += len(pieces)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each piece of data."""
        h = word_hashes(data, starts, ends) | np.uint64(1)
        again = (_ends(data, starts, ends) >> np.uint64(32)).astype(np.uint32)
        out, _ = self._probe(h, again, np.arange(len(h)))
        new = np.flatnonzero(out < 0)
        if len(new):
            order = new[np.lexsort((again[new], h[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (again[order][1:] != again[order][:-1])
            lead = order[first]
            if self.known + len(lead) > MEMORY and self.known:
                self.clear()
                return self(data, starts, ends)
            raw = data.tobytes()
            self._learn([raw[a:b].decode() for a, b in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)], h[lead], again[lead])
            out[new] = self._probe(h, again, new)[0][new]
        return out


def _separator(tok) -> int | None:
    """The id of a lone 7, if it stands for itself between any two words."""
    one, split = tok.encode("7", add_special_tokens=False).ids, [tok.encode(x, add_special_tokens=False).ids for x in ("a,b 7 don't 7 !? 7", "a,b", "don't", "!?")]
    return one[0] if len(one) == 1 and split[0] == split[1] + one + split[2] + one + split[3] + one else None


def _ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each piece's length, first and last eight bytes in one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    length = ends - starts
    keep = _KEEP[np.minimum(length, 8)]
    with np.errstate(over="ignore"):
        tail = eight[np.maximum(starts, ends - 8)] & keep
        return mix64(eight[starts] & keep) ^ (tail * np.uint64(0xD6E8FEB86659FD93)) ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _lowered(data: np.ndarray) -> np.ndarray:
    """Capitals of ASCII and of U+00C0 to U+00DE in lower case, but for one that a mark may join to."""
    low = _LOWER[data]
    after = np.append(data[1:], np.uint8(0)) >= 0xC4
    low[after] = data[after]
    wide = np.flatnonzero(data == 0xC3) + 1
    wide = wide[(wide < len(data))]
    second = data[wide]
    low[wide[(second <= 0x9E) & (second != 0x97) & ~after[wide]]] += 32
    return low


def _encoded(column: pa.Array, path: str, spaced: bool, ids: bool):
    memory = _memories.get((path, ids))
    if memory is None:
        memory = _memories[path, ids] = _Memory(tokenizer(path), ids)
    data, at = utf8(column)
    if not len(data):
        return memory, np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    raw = _LOWER[data].tobytes()
    plain = not any(x.lower() in raw for x in memory.special)  # texts with an added token keep whole words and case
    if plain and memory.caseless:
        data = _lowered(data)
    starts, ends = (_pieces_spaced if spaced else _pieces_bare)(data, at, plain and memory.parts)
    return memory, memory(data, starts, ends) if len(starts) else np.zeros(0, np.int64), np.searchsorted(starts, at)


def count_tokens(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text under a byte-level tokenizer."""
    memory, entry, first = _encoded(column, path, True, False)
    sums = np.append(0, np.cumsum(memory.length[entry]))
    return sums[first[1:]] - sums[first[:-1]]


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, offsets) under a tokenizer that drops white space."""
    memory, entry, first = _encoded(column, path, False, True)
    lengths = memory.length[entry]
    sums = np.append(0, np.cumsum(lengths))
    where = np.repeat(memory.start[entry] - sums[:-1], lengths) + np.arange(sums[-1])
    return memory.store[where].astype(np.uint32), sums[first]


class IdCounter:
    """How often each id occurs in texts, by counting pieces: ids are looked up once for each different piece."""

    def __init__(self, path: str):
        self.path, self.seen, self.total, self.memory, self.life = path, np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0

    def add(self, column: pa.Array) -> None:
        # Entries are only good until the memory starts afresh, which a call may do: then settle first.
        memory = _memories.get((self.path, True))
        if memory is not None and memory is self.memory:
            before = memory.start, memory.length, memory.store
        self.memory, entry, _ = _encoded(column, self.path, False, True)
        if self.memory.life != self.life:
            if len(self.seen):
                self._settle(*before)
            self.life = self.memory.life
        n = np.bincount(entry)
        if len(n) > len(self.seen):
            self.seen = np.append(self.seen, np.zeros(len(n) - len(self.seen), np.int64))
        self.seen[: len(n)] += n

    def _settle(self, start: np.ndarray, length: np.ndarray, store: np.ndarray) -> None:
        used = np.flatnonzero(self.seen)
        lengths = length[used]
        sums = np.append(0, np.cumsum(lengths))
        ids = store[np.repeat(start[used] - sums[:-1], lengths) + np.arange(sums[-1])]
        n = np.bincount(ids, np.repeat(self.seen[used], lengths)).astype(np.int64)
        if len(n) > len(self.total):
            self.total = np.append(self.total, np.zeros(len(n) - len(self.total), np.int64))
        self.total[: len(n)] += n
        self.seen = np.zeros(0, np.int64)

    def counts(self) -> np.ndarray:
        if len(self.seen):
            self._settle(self.memory.start, self.memory.length, self.memory.store)
        return self.total
