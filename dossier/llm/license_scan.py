"""Licence scans: texts against licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.memory import lean
from dossier.llm.words import mix64, slices, spans, utf8, word_hashes

# Notices as their licences word them. The full texts are in the folder licences.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "reserved": ["All rights reserved."],
}
#: Windows have their template's number of bigrams, and steps of this share more and less, as far as the threshold allows.
STEP = 0.05
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[[*range(48, 58), *range(97, 123)]] = [*range(48, 58), *range(97, 123)]
_FOLD[65:91] = np.arange(97, 123)


def licence_templates() -> dict[str, list[str]]:
    """Notices and full texts by licence."""
    out = {k: list(v) for k, v in NOTICES.items()}
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        out.setdefault(path.stem, []).append(path.read_text())
    return out


def _bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each pair of neighbouring words, index of each text's first pair and the end); words are runs of a-z, A-Z and 0-9."""
    data, at = utf8(column)
    data = _FOLD[data]
    starts, ends, first = spans(data, at)
    w = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        pairs = mix64(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:]) if len(w) else w
    inside = np.ones(len(pairs), bool)
    ends = first[1:-1]
    inside[ends[(ends > 0) & (ends <= len(pairs))] - 1] = False  # a pair does not reach over the end of its text
    return pairs[inside], np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(first) - 1))])


class Scanner:
    """Templates as counts of bigrams; only those are compared of which a text has enough for the threshold."""

    def __init__(self, templates: dict[str, list[str]], threshold: float, step: float = STEP):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.threshold = threshold
        known = []
        for name, texts in templates.items():
            for text in texts:
                pairs, _ = _bigrams(pa.array([text]))
                if len(pairs):
                    known.append((len(pairs), name, *np.unique(pairs, return_counts=True)))
        known.sort(key=lambda k: (k[0], k[1]))
        self.sizes, self.names, self.kinds, self.caps = [k[0] for k in known], [k[1] for k in known], [k[2] for k in known], [k[3] for k in known]
        self.lengths = [self._lengths(m, step) for m in self.sizes]
        # Dice of m and n bigrams needs threshold (m + n) / 2 in common; the shortest window needs least.
        self.least = np.array([threshold * (m + n[0]) / 2 for m, n in zip(self.sizes, self.lengths, strict=True)])
        self.all = np.unique(np.concatenate([*self.kinds, np.zeros(0, np.uint64)]))
        owner = [np.full(len(k), t) for t, k in enumerate(self.kinds)]
        where = np.searchsorted(self.all, np.concatenate([*self.kinds, np.zeros(0, np.uint64)]))
        order = np.argsort(where, kind="stable")
        #: The templates of each bigram of all, one after another.
        self.owner = np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.first = np.searchsorted(where[order], np.arange(len(self.all) + 1))

    def _lengths(self, m: int, step: float) -> list[int]:
        """Window sizes in bigrams. Dice of sizes m and n is at most 2 min(m, n) / (m + n), which bounds n."""
        low, high = math.ceil(m * self.threshold / (2 - self.threshold) - 1e-9), math.floor(m * (2 - self.threshold) / self.threshold + 1e-9)
        out, n = {m, low, high}, float(m)
        for factor in (1 + step, 1 / (1 + step)):
            n = m * factor
            while low < n < high:
                out.add(round(n))
                n *= factor
        return sorted(x for x in out if x > 0)

    def _overlap(self, known: np.ndarray, template: int, n: int, total: int) -> np.ndarray:
        """Bigrams in common with the template of each window of n of the text's total bigrams.

        known is (bigram, position) of those in the template, sorted. Of a bigram that the template has c
        times, an occurrence counts in the windows that hold it and less than c earlier ones.
        """
        kinds, caps = self.kinds[template], self.caps[template]
        value, place = known
        group = np.searchsorted(kinds, value)
        start = np.searchsorted(value, value)  # where the occurrences of the same bigram begin
        nth, cap = np.arange(len(value)) - start, caps[group]
        before = np.where(nth >= cap, place[np.maximum(np.arange(len(value)) - cap, 0)], -1)
        lo, hi = np.maximum(np.maximum(place - n, before), -1) + 1, np.minimum(place, total - n) + 1
        steps = np.zeros(total - n + 2, np.int64)
        ok = lo < hi
        np.add.at(steps, lo[ok], 1)
        np.add.at(steps, hi[ok], -1)
        return np.cumsum(steps)[: total - n + 1]

    def _matches(self, pairs: np.ndarray, template: int) -> tuple[float, list[tuple[int, int]]]:
        """The best Dice coefficient of the text's windows, and the runs of bigrams that windows over the threshold cover."""
        m, total = self.sizes[template], len(pairs)
        kinds = self.kinds[template]
        at = np.minimum(np.searchsorted(kinds, pairs), len(kinds) - 1)
        place = np.flatnonzero(kinds[at] == pairs)
        order = np.argsort(pairs[place], kind="stable")
        known = pairs[place][order], place[order]
        best, runs = 0.0, []
        for n in sorted({min(n, total) for n in self.lengths[template]}):
            dice = 2 * self._overlap(known, template, n, total) / (m + n)
            hit = np.flatnonzero(dice >= self.threshold - 1e-12)
            if len(hit):
                best = max(best, float(dice[hit].max()))
                cuts = np.flatnonzero(np.diff(hit) > n) + 1  # windows that neither meet nor overlap
                runs += [(int(p[0]), int(p[-1]) + n) for p in np.split(hit, cuts)]
        return best, runs

    def scan(self, column: pa.Array) -> list[tuple[int, list[str], str | None, float]]:
        """For each text (stretches that match, licences found, the best, its Dice coefficient)."""
        pairs, first = _bigrams(column)
        out = [(0, [], None, 0.0)] * (len(first) - 1)
        if not len(self.all) or not len(pairs):
            return out
        at = np.minimum(np.searchsorted(self.all, pairs), len(self.all) - 1)
        hit = np.flatnonzero(self.all[at] == pairs)
        text = np.searchsorted(first, hit, "right") - 1
        # One entry for each text and template of a hit; enough of them, or the template is out.
        n = self.first[at[hit] + 1] - self.first[at[hit]]
        where = np.repeat(self.first[at[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both, count = np.unique(np.repeat(text, n) * len(self.sizes) + self.owner[where], return_counts=True)
        enough = both[count >= self.least[both % len(self.sizes)] - 1e-9]
        found: dict[int, list] = {}
        for k in enough.tolist():
            doc, template = divmod(k, len(self.sizes))
            dice, runs = self._matches(pairs[first[doc] : first[doc + 1]], template)
            if runs:
                found.setdefault(doc, []).append((-dice, -self.sizes[template], self.names[template], runs))
        for doc, hits in found.items():
            end, stretches = -1, 0
            for a, b in sorted(r for h in hits for r in h[3]):
                stretches += a > end
                end = max(end, b)
            dice, _, name, _ = min(hits, key=lambda h: h[:3])
            out[doc] = (stretches, sorted({h[2] for h in hits}), name, round(-dice, 6))
        return out


def scan_licences(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_matches, licences (sorted), best_licence, best_dice.

    A text is compared with each notice and full licence text by the Dice coefficient of word bigrams,
    counted as often as they occur; case, marks and line breaks are dropped. What is compared are all
    windows of the text as long as the template, and in steps of a twentieth shorter and longer as far
    as the threshold allows (a text that is shorter than a window is one), so a licence is found inside
    any other words and however it is wrapped. A template is left out only if the text has too few of
    its bigrams for any window to reach the threshold. n_matches counts the stretches of text that such
    windows cover. Words and bigrams are compared by 64-bit hashes.

    Null and empty texts match nothing; of equal coefficients that of the longer template
    wins, then the name first in order. Texts of
    any length are scanned whole; repeated rows are scanned each. Extra columns are ignored; an empty
    table gives an empty result.
    """
    templates = licence_templates() if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            for i, j in slices(batch.column(1), 1 << 20):
                part = batch.slice(i, j - i)
                rows = scanner.scan(part.column(1))
                kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], ["_id", "n_matches", "licences", "best_licence", "best_dice"])

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    out = rows.mapInArrow(lean("licences", run), f"_id {kind}, n_matches long, licences array<string>, best_licence string, best_dice double")
    return out.withColumnRenamed("_id", id_col)
