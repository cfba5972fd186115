"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Texts and templates are lower-cased words of letters and digits, in shingles of ``SHINGLE`` words.  For a template of m
shingles the window has W shingles, the smallest power of two with W >= 4 m / 3, and windows begin every W / 4
shingles, so one window holds any occurrence whole and their Jaccard similarity is at least m / W > 3/8.
A band is one minimum of W hash values; with 24 bands an occurrence is missed with a probability below
(1 - 3/8)^24 = 0.000013.  The minima of larger windows come from those of smaller blocks, so every shingle is hashed once
for each band whatever the number of window lengths.  A retrieved template is verified by the share of its
distinct shingles in the window and its surroundings of W shingles to each side.

Cases: null and empty texts have no license; a text or template of fewer words than a shingle is one shingle of its words; an
occurrence is reported once for each document and template, with the best containment and the first word of the
window; repeated rows are reported alike; an id column with a result's name, in any case, is replaced.  Templates are sent to the workers in
blocks of about ``BLOCK`` characters, a pass over the documents for each block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

SHINGLE, BANDS, CONTAINMENT = 3, 24, 0.8
BLOCK = 16 << 20
#: Short notices and opening passages of public licenses.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_H: list[tc.Hasher] = []
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One value for each word: the shingle that begins there, _NONE near a row's end; and the first word of each row."""
    if not _H:
        _H.append(tc.Hasher(13))
    starts, ends, bounds = tc.spans(data, offsets, tc.ALNUM)
    h = _H[0](tc.LOWER[data], starts, ends)
    out = np.full(len(h), _NONE)
    inside = tc.inside_rows(bounds, SHINGLE)
    out[: len(inside)][inside] = tc.ngrams(h, SHINGLE)[inside]
    size = np.diff(bounds)
    for row in np.flatnonzero((size > 0) & (size < SHINGLE)):
        out[bounds[row]] = _H[0].runs(h, bounds[row : row + 1], bounds[row + 1 : row + 2])[0]
    return out, bounds


def _bands(seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, BANDS, dtype=np.uint64), rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Templates:
    """Distinct shingles of each template, and by window length the templates' minima for each band."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.sets, self.levels = [], [], {}
        for name, text in sorted(templates.items()):
            raw = np.frombuffer(text.encode(), np.uint8)
            own, _ = _shingles(raw, np.array([0, len(raw)]))
            own = np.unique(own[own != _NONE])
            if len(own):
                level = max(0, int(np.ceil(np.log2(4 * len(own) / 3))) - 2)  # the window has 4 * 2^level shingles
                self.levels.setdefault(level, []).append(len(self.names))
                self.names.append(name)
                self.sets.append(own)
        xor, times = _bands()
        self.minima = {level: [np.array([((self.sets[k] ^ x) * t).min() for k in ks]) for x, t in zip(xor, times, strict=True)] for level, ks in self.levels.items()}

    def windows(self, g: np.ndarray) -> set[tuple[int, int]]:
        """(template, first word of the window) of the windows that share a band with a template."""
        out: set[tuple[int, int]] = set()
        none = g == _NONE
        xor, times = _bands()
        for band in range(BANDS):
            low = (g ^ xor[band]) * times[band]
            low[none] = _NONE
            for level in range(max(self.levels, default=-1) + 1):
                if level:
                    low = np.append(low, _NONE) if len(low) % 2 else low
                    low = np.minimum(low[::2], low[1::2])
                if level in self.levels:
                    half = np.minimum(low[:-1], low[1:]) if len(low) > 1 else low
                    four = np.minimum(half[:-2], half[2:]) if len(half) > 2 else half
                    for k, value in zip(self.levels[level], self.minima[level][band], strict=True):
                        out.update((k, int(p) << level) for p in np.flatnonzero(four == value))
                    # The last windows of the slice are shorter.
                    tail = low[-4:]
                    for p in range(len(tail)):
                        for k, value in zip(self.levels[level], self.minima[level][band], strict=True):
                            if tail[p:].min() == value:
                                out.add((k, (len(low) - len(tail) + p) << level))
        return out


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    text_col: str = "text",
    id_cols: tuple[str, ...] = ("doc_id",),
    least: float = CONTAINMENT,
    block: int = BLOCK,
) -> DataFrame:
    """id columns, license, containment, n_words of the template's window and its first word, for each license found in a text."""
    blocks: list[dict[str, str]] = [{}]
    size = 0
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        if blocks[-1] and size + len(text) > block:
            blocks.append({})
            size = 0
        blocks[-1][name] = text
        size += len(text)
    keep = tc.others(id_cols, "license", "containment", "start_word", "window")
    out = [_scan(docs, given, text_col, keep, least) for given in blocks]
    return functools.reduce(DataFrame.unionAll, out)


def _scan(docs: DataFrame, given: dict[str, str], text_col: str, keep: list[str], least: float) -> DataFrame:
    own_text = tc.free(keep, "text_")[0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Templates(given)
        level_of = {k: level for level, ks in own.levels.items() for k in ks}
        for batch in batches:
            col = tc.text_column(batch, own_text)
            for i, j in tc.slices(col):
                g, bounds = _shingles(*tc.raw(col.slice(i, j - i)))
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for k, p in own.windows(g):
                    width = 4 << level_of[k]
                    for row in range(int(np.searchsorted(bounds, p, "right")) - 1, int(np.searchsorted(bounds, min(p + width, len(g)) - 1, "right"))):
                        a, b = max(bounds[row], p - width), min(bounds[row + 1], p + 2 * width)
                        share = np.isin(own.sets[k], g[a:b]).mean() if b > a else 0.0
                        if share >= least:
                            best[row, k] = min(best.get((row, k), (0.0, 0)), (-float(share), max(0, p - int(bounds[row]))))
                found = sorted((row, own.names[k], -s, p, 4 << level_of[k]) for (row, k), (s, p) in best.items())
                rows = pa.array([i + x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keep), *(pa.array([x[n] for x in found], kind) for n, kind in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64())))], [*keep, "license", "containment", "start_word", "window"])

    kinds = ", ".join(x for x in (tc.kinds(docs, keep), "license string, containment double, start_word long, window long") if x)
    return docs.select(*keep, F.col(text_col).alias(own_text)).mapInArrow(of, kinds)
