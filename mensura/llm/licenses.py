"""License scans: fingerprints of runs of words, then banded alignment.

Templates are cut into overlapping runs of words, all of which form an inverted
index from hash to places in templates. Runs have 3 words, or 2 where 3 in a row
need not survive one more word between two or as many other words as the
coverage allows; so whatever words are changed, or one is put in, a template
that is covered enough is a candidate. One that has words both changed and put
in at several places may be missed.
A document's runs are looked up in the index; hits of one
template on about the same diagonal make a candidate. Each candidate is aligned
with the template by local alignment of words inside a band, which reports how
much of the template is matched and where in the document. Templates are a fixed
list, so nothing of the corpus is gathered or shuffled.

Defined results: a null or empty text matches nothing; very long texts are used
whole; several places of one template in a text are several spans; of templates
that match at overlapping places the longer match is reported; equal rows give
equal rows; a row without an id gives rows without one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mensura.llm._store import bounded, frugal
from mensura.llm._text import LOWER, Slice, bare, hash_words, mix, slices

RUN = 3
BAND = 8
COVERAGE = 0.75
# Public license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "lgpl-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_EDGE = np.zeros(256, bool)
_EDGE[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
MATCHES = "doc_id long, license string, coverage double, span_start int, span_end int, matched_words int, template_words int"


def bare_words(s: Slice):
    """Starts and ends of a slice's words without outer punctuation, their hashes in lower case, and each text's first word.

    Words of nothing but punctuation, as the marks of comment lines, are left out.
    """
    data = LOWER[s.data]
    starts, ends, first = s.words(data)
    begin, end = bare(data, starts, ends, _EDGE)
    some = end > begin
    begin, end, first = begin[some], end[some], np.concatenate([[0], np.cumsum(some)])[first]
    return begin, end, hash_words(data, begin, end), first


def runs(words: np.ndarray, size: int = RUN) -> np.ndarray:
    """A hash of every ``size`` words in a row."""
    out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x94D049BB133111EB) + mix(words[k : k + len(out)] + np.uint64(k))
    return mix(out)


def run_size(size: int, least: float) -> int:
    """Words in a row, RUN at most, that a template of ``size`` words keeps whichever words are changed or one is put in."""
    need = max(min(int(np.ceil(least * size - 1e-9)), size), 1)
    return max(1, min(RUN, -(-need // (size - need + 1)), -(-size // 2)))


class Index:
    """The inverted index from fingerprint to (template, place), by size of run."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE):
        self.names = list(templates)
        self.words = [bare_words(next(iter(slices(pa.array([t])))))[2] for t in templates.values()]
        found: dict[int, list] = {}
        for i, words in enumerate(self.words):
            k = run_size(len(words), least)
            h = runs(words, k)
            found.setdefault(k, []).append((h, np.full(len(h), i), np.arange(len(h))))
        self.sizes = {}
        for k, parts in found.items():
            keys, which, at = map(np.concatenate, zip(*parts))
            order = np.argsort(keys, kind="stable")
            self.sizes[k] = keys[order], which[order], at[order]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in words, template, place in template, text) of all fingerprints found inside of texts, by place."""
        out = []
        for k, (keys, which, at) in self.sizes.items():
            hashes = runs(words, k)
            low = np.searchsorted(keys, hashes, "left")
            some = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == hashes))
            many = np.searchsorted(keys, hashes[some], "right") - low[some]
            place = np.repeat(some, many)
            entry = np.repeat(low[some] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(some) else np.zeros(0, int)
            doc = np.searchsorted(first, place, "right") - 1
            inside = place + k <= first[doc + 1]
            out.append((place[inside], which[entry][inside], at[entry][inside], doc[inside]))
        place, which, at, doc = map(np.concatenate, zip(*out))
        order = np.argsort(place, kind="stable")
        return place[order], which[order], at[order], doc[order]


def banded_alignment(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Words matched, and the first and last matched place in ``text`` (-1: none), by local alignment around a diagonal.

    A match scores 2, a substitution or gap -1; cell (i, j) is reached only where
    j lies within ``band`` of i + ``diagonal``.
    """
    width = 2 * band + 1
    score, matched, begin = [0] * (width + 2), [0] * (width + 2), [-1] * (width + 2)
    best = (0, 0, -1, -1)
    for i, word in enumerate(template.tolist()):
        new_score, new_matched, new_begin = [0] * (width + 2), [0] * (width + 2), [-1] * (width + 2)
        for b in range(1, width + 1):
            j = i + diagonal + b - 1 - band
            if not 0 <= j < len(text):
                continue
            same = int(text[j]) == word
            options = [(0, 0, -1)]
            options.append((score[b] + (2 if same else -1), matched[b] + same, begin[b] if begin[b] >= 0 else (j if same else -1)))
            options.append((score[b + 1] - 1, matched[b + 1], begin[b + 1]))
            options.append((new_score[b - 1] - 1, new_matched[b - 1], new_begin[b - 1]))
            new_score[b], new_matched[b], new_begin[b] = top = max(options)
            if same and top[0] > best[0]:
                best = (*top, j)
        score, matched, begin = new_score, new_matched, new_begin
    return best[1], best[2], best[3]


def matches(index: Index, words: np.ndarray, hits: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word) of a text's candidates that are covered enough, the best where they overlap."""
    found = []
    done: list[tuple[int, int]] = []
    for place, template, at in sorted(hits, key=lambda h: (h[1], h[0] - h[2])):
        diagonal = place - at
        size = len(index.words[template])
        band = min(BAND, max(1, size // 4))  # short templates may follow one another closely
        if done and done[-1][0] == template and diagonal - done[-1][1] <= band:
            continue
        done.append((template, diagonal))
        low = max(0, diagonal - band)
        n, first, last = banded_alignment(words[low : diagonal + size + band + 1], index.words[template], diagonal - low, band)
        if n >= least * size and n >= min(size, RUN):
            found.append((template, n, low + first, low + last))
    kept: list = []  # by place, so that only neighbours can overlap
    for m in sorted(found, key=lambda m: (-m[1], len(index.words[m[0]]), m[0], m[2])):
        at = bisect.bisect_left(kept, m[2], key=lambda k: k[2])
        if (at == 0 or kept[at - 1][3] < m[2]) and (at == len(kept) or m[3] < kept[at][2]):
            kept.insert(at, m)
    return kept


def _scan(templates: dict[str, str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, least)
        names = [x.split()[0] for x in MATCHES.split(", ")]
        types = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 4]
        for batch in batches:
            rows = []
            for s in slices(batch.column("text")):
                begin, end, words, first = bare_words(s)
                place, which, at, doc = index.hits(words, first)
                cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(doc))):
                    d = int(doc[a])
                    w0 = int(first[d])
                    local = words[w0 : first[d + 1]]
                    row = s.rows.start + d
                    raw = s.data[s.offsets[d] : s.offsets[d + 1]]
                    for t, n, x, y in matches(index, local, list(zip((place[a:b] - w0).tolist(), which[a:b].tolist(), at[a:b].tolist())), least):
                        i, j = int(begin[w0 + x] - s.offsets[d]), int(end[w0 + y] - s.offsets[d])
                        chars = lambda k: int((raw[:k] & 0xC0 != 0x80).sum())
                        rows.append((batch.column("doc_id")[row].as_py(), index.names[t], n / len(index.words[t]), chars(i), chars(j), n, len(index.words[t])))
            yield pa.record_batch({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """A row for each matched span (in characters) of documents(doc_id, text)."""
    return bounded(docs).select("doc_id", "text").mapInArrow(frugal(_scan(templates, least)), MATCHES)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
