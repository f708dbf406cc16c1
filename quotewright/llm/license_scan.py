"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of characters other than blanks and ASCII punctuation, with A-Z folded.  Template and text
become shingles of five words (templates with fewer: one shingle of all their words).  A template of ``m``
shingles is looked for in windows of the next power of two ``w >= m`` shingles, a quarter apart, with
MinHash bands of one value.  Where a template stands whole or to ``LEAST`` of its shingles, some window
shares with it at least ``overlap(m)`` of their union, whatever else the window holds, so all of ``n``
bands miss with probability ``(1 - overlap) ** n``; ``bands(m)`` takes as many as bring that below ``MISS``.

A window that shares a band with a template is a candidate.  The template matches a text if at least
``LEAST`` of its shingles lie in the window widened by its own length on both sides, within that text.
Whole batches are windowed at once; windows over two texts are candidates for both.

Null, empty or blank text matches nothing.  Rows that repeat match alike; a null id is one more row; extra
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .wordhash import Chunk, chunks, sequence_hashes, sliding

SHINGLE, LEAST, MISS = 5, 0.8, 1e-4

# Notices as licensors word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def overlap(m: int) -> float:
    """Least Jaccard share of the best window with a template of ``m`` shingles."""
    w = 1 << max(0, m - 1).bit_length()
    stride = max(1, w // 4)
    both = max(1, math.ceil(LEAST * m) - (stride - 1 if w - m < stride - 1 else 0))
    return both / (m + w - both)


def bands(m: int) -> int:
    """Bands after which a template of ``m`` shingles is missed with probability below ``MISS``."""
    share = overlap(m)
    return 1 if share >= 1 else math.ceil(math.log(MISS) / math.log(1 - share))


@dataclass(frozen=True)
class Template:
    name: str
    words: int  # of a shingle
    window: int
    shingles: np.ndarray
    least: np.ndarray


class Library:
    """Templates by (words of a shingle, window), with their MinHash values."""

    def __init__(self, texts: Mapping[str, str]):
        self.groups: dict[tuple[int, int], list[Template]] = {}
        for name, text in sorted(texts.items()):
            words = next(chunks(pa.array([text]), "plain")).hashes
            k = min(SHINGLE, len(words))
            if k:
                s = np.unique(sequence_hashes(words, k))
                window = 1 << max(0, len(s) - 1).bit_length()
                least = np.array([self.hashed(s, i).min() for i in range(bands(len(s)))], np.uint32)
                self.groups.setdefault((k, window), []).append(Template(name, k, window, s, least))

    @staticmethod
    def hashed(shingles: np.ndarray, band: int) -> np.ndarray:
        """The hash function of one band: the upper half of an odd multiple that the band chooses."""
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * band + 1)) & (1 << 64) - 1 | 1)
        return ((shingles * factor) >> np.uint64(32)).astype(np.uint32)

    def scan(self, c: Chunk) -> Iterator[tuple[int, str, float, int]]:
        """(text number, template, containment, word where its best window begins), the best of each text and template."""
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for (k, window), templates in self.groups.items():
            s = sequence_hashes(c.hashes, k)
            if not len(s):
                continue
            stride = max(1, window // 4)
            candidates: list[set[int]] = [set() for _ in templates]
            for band in range(max(len(t.least) for t in templates)):
                h = self.hashed(s, band)
                if stride > 1:
                    h = np.minimum.reduceat(h, np.arange(0, len(h), stride))
                if window > stride:  # as many strides as make a window
                    pad = np.full(window // stride - 1, 0xFFFFFFFF, np.uint32)
                    h = sliding(np.concatenate((h, pad)), window // stride, np.minimum)
                for t, found in zip(templates, candidates, strict=True):
                    if band < len(t.least):
                        found.update(np.flatnonzero(h == t.least[band]).tolist())
            for t, found in zip(templates, candidates, strict=True):
                for i in sorted(found):
                    lo, hi = max(0, i * stride - window), min(len(s), i * stride + 2 * window)
                    for text in range(c.text[lo], c.text[hi - 1] + 1):
                        a, b = max(lo, int(c.first[text])), min(hi, int(c.first[text + 1]) - k + 1)
                        if a < b:
                            share = float(np.isin(t.shingles, s[a:b]).sum() / len(t.shingles))
                            if share >= LEAST and share > best.get((text, t.name), (0.0, 0))[0]:
                                best[text, t.name] = share, max(i * stride, int(c.first[text])) - int(c.first[text])
        for (text, name), (share, at) in sorted(best.items()):
            yield text, name, share, at


def scan(docs: DataFrame, texts: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id and ``matches`` (template, containment, start) of every document."""
    kind = pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("start", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(texts)
        for b in batches:
            for c in chunks(b.column(1), "plain"):
                found: list[list[dict]] = [[] for _ in c.rows]
                for text, name, share, at in library.scan(c):
                    found[text].append({"template": name, "containment": share, "start": at})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.rows.start, len(c.rows)), pa.array(found, kind)], names=["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(rows), "doc_id long, matches array<struct<template:string,containment:double,start:long>>")
