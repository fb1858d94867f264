"""Token counts; huge texts by overlapping chunks that are spliced where both agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.memory import lean
from dossier.llm.tokens import count_tokens, tokenizer
from dossier.llm.words import slices

#: Characters of a chunk and of the overlap of two; texts of up to one chunk go by their pieces.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Tokens after a splice that must be the same in both chunks, where the overlap holds so many.
AGREE = 8
_WHITE = frozenset(" \t\n\r\x0b\x0c")
# Blocks of letters (first, last) and marks whose kinds have long been settled.
_LETTERS = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x410, 0x44F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~、。，！？；：（）「」『』《》")
_DIGITS = frozenset("0123456789")


def _letter(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _LETTERS)


def certain(text: str, p: int) -> bool:
    """Whether a pre-token starts at p whatever stands before: an ASCII space after something else, a mark (no
    apostrophe) or a digit after a letter, a letter after a digit. Runs of letters, of digits and of marks are pre-tokens of their own."""
    a, b = text[p - 1], text[p]
    if b in _WHITE:
        return not a.isspace()
    if _letter(a):
        return b in _MARKS or b in _DIGITS
    return a in _DIGITS and _letter(b)


def _splice(text: str, a: list[tuple[int, int]], a_ids: list[int], a_end: int, b: list[tuple[int, int]], b_ids: list[int], b_at: int) -> tuple[int, int] | None:
    """(token of a, token of b) at which both start anew at the same place of text, or None.

    The place is certain(): byte-level pre-tokens always start there, whatever came before, so both
    chunks' tokens from it on are the text's own until the first chunk ends. It lies inside the
    overlap, and the tokens after it must agree in both.
    """
    starts = {}
    for j in range(len(b)):
        if b[j][0] + b_at < a_end:
            starts.setdefault(b[j][0] + b_at, j)
        else:
            break
    i = int(np.searchsorted([x for x, _ in a], b_at, "right"))
    for i in range(i, len(a)):
        p = a[i][0]
        j = starts.get(p)
        if j is None or p <= b_at or not certain(text, p):
            continue
        n = min(AGREE, len(a_ids) - i - 2)
        if n > 0 and a_ids[i : i + n] == b_ids[j : j + n]:
            return i, j
    return None


def count_long(text: str, tok, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length; no more than a few chunks are encoded at a time, unless a run of
    letters, or of any one kind, is longer: then the chunk grows to its end."""
    enc = lambda lo, hi: tok.encode(text[lo:hi], add_special_tokens=False)
    total, at, size = 0, 0, chunk
    now = enc(at, at + size)
    spans, ids, skip = [(x + at, y + at) for x, y in now.offsets], now.ids, 0
    while at + size < len(text):
        end, lap, joined = at + size, overlap, None
        while joined is None:
            start = end - lap
            if start <= at:
                # No place in the whole chunk: it grows, from the same certain start.
                size *= 2
                now = enc(at, at + size)
                spans, ids = [(x + at, y + at) for x, y in now.offsets], now.ids
                if at + size >= len(text):
                    break
                end, lap = at + size, overlap
                continue
            ahead = enc(start, start + chunk)
            joined = _splice(text, spans, ids, end, ahead.offsets, ahead.ids, start)
            lap *= 2
        if joined is None:
            break
        i, j = joined
        total += i - skip
        at, size, skip = start, chunk, j
        spans, ids = [(x + at, y + at) for x, y in ahead.offsets], ahead.ids
    return total + len(ids) - skip


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (more than limit tokens).

    path is a tokenizers .json of the byte-level kind that adds no space in front. Null counts as
    empty; empty texts have no tokens. Texts of over chunk bytes are encoded in overlapping chunks that
    are spliced. Repeated rows are counted each; extra columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for i, j in slices(batch.column(2)):
                part = batch.slice(i, j - i)
                text, long = part.column(2), np.asarray(part.column(1)) > chunk
                n = count_tokens(pa.array([None if x else t for t, x in zip(text.to_pylist(), long, strict=True)], pa.string()) if long.any() else text, path)
                for k in np.flatnonzero(long):
                    n[k] = count_long(text[int(k)].as_py(), tok, chunk)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64))], ["_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    out = rows.mapInArrow(lean("tokens", run), f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
