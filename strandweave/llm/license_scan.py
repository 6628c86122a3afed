"""License scan: MinHash bands retrieve templates, exact containment verifies them.

A template occurs in a text where a stretch holds at least `containment` of its
word shingles and is at most STRETCH times as long as the template (words may be
inserted or changed in it). For templates of about one length, blocks are at least
such a stretch long; windows are two blocks and start every block, so each occurrence
lies whole in some window, and its Jaccard likeness to the template has a least value
J, which `likeness_floor` works out. With r rows a band, b bands are as many as make
the chance that such a window shares no band with the template less than `miss`:
(1 - J^r)^b < miss. A window's bands are looked up in the sorted bands of all
templates of the class.

Two sets have a minimum in common only if they have that shingle in common, so
signatures are made of those windows alone that hold some shingle of a template.
Templates are a bounded parameter and travel with the code; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.words import SPACE, Texts, Words, mixed, sliced, texts_of

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-3
ROWS = 2
STRETCH = 1.5

# Notices as they stand in files, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "MIT License",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    # Its words alone, without a license.
    "LicenseRef-All-Rights-Reserved": ["All rights reserved."],
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
for _c in b"!\"#$%&'()*+,/:;<=>?@[\\]^_`{|}~":
    _FOLD[_c] = 0x20


def _folded(texts: Texts) -> Words:
    """Words in lower case without punctuation; full stops and hyphens inside a word stay."""
    data = _FOLD[texts.data]
    after = np.append(data[1:], 0x20)
    after[texts.offsets[1:][texts.offsets[1:] > texts.offsets[:-1]] - 1] = 0x20
    data = np.where(((data == 0x2E) | (data == 0x2D)) & SPACE[after], np.uint8(0x20), data)
    return Texts(data, texts.offsets).words()


@dataclass
class Template:
    license: str
    shingles: np.ndarray  # distinct, sorted
    size: int  # in shingles, as it stands


@dataclass
class Class:
    """Templates of one length class: block length in shingles, all their shingles, and their bands, sorted, with the template of each."""

    block: int
    templates: list[int]
    known: np.ndarray
    bands: np.ndarray
    owners: np.ndarray


def likeness_floor(containment: float) -> float:
    """Least Jaccard likeness of a template to a window of two blocks that holds its share.

    A template has, in blocks, between half of 1 / STRETCH and 1 / STRETCH of shingles;
    the window has two blocks of them at most.
    """
    least = 0.5 / STRETCH
    return containment * least / (2 + (1 - containment) * least)


def block_of(size: int) -> int:
    """The block of a template's class: the power of two that holds its longest stretch."""
    return 1 << max(0, math.ceil(math.log2(size * STRETCH)))


def bands_for(containment: float, miss: float = MISS, rows: int = ROWS) -> int:
    """Bands that leave a chance below miss that a true window shares none."""
    return math.ceil(math.log(miss) / math.log(1 - likeness_floor(containment) ** rows))


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles, and where each row's start; a row of fewer words has one of all its words."""
    hashes = words.hashes()
    at, h = words.windows(size, hashes)
    n = np.diff(words.offsets)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = np.array([_hash_all(hashes[words.offsets[k] : words.offsets[k + 1]]) for k in short], dtype=np.uint64)
        at = np.concatenate([at, words.offsets[:-1][short]])
        h = np.concatenate([h, own])
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
    return h, np.searchsorted(at, words.offsets)


def _hash_all(hashes: np.ndarray) -> int:
    out = 0
    for x in hashes.tolist():
        out = (out * 0x2545F4914F6CDD1D + x) & (1 << 64) - 1
    return out


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n hashes."""
    k = np.arange(1, n + 1, dtype=np.uint64)
    return mixed(k, 41) | np.uint64(1), mixed(k, 42)


def _signature(shingles: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """The least value of each hash of the family over the shingles."""
    return (shingles[None, :] * factors[:, None] + summands[:, None]).min(axis=1)


class Scanner:
    """Templates with their bands; scans batches of texts."""

    def __init__(self, templates: dict[str, list[str]], shingle: int = SHINGLE, containment: float = CONTAINMENT, miss: float = MISS):
        self.shingle, self.containment = shingle, containment
        self.templates: list[Template] = []
        # Notices of fewer words than a shingle, by length: their hashes, sorted, and the license of each.
        short: dict[int, set[tuple[int, str]]] = {}
        for name, texts in templates.items():
            for text in texts:
                words = _folded(texts_of(pa.array([text])))
                h, at = _shingles(words, shingle)
                if 0 < (n := len(words.starts)) < shingle:
                    short.setdefault(n, set()).add((int(words.windows(n, words.hashes())[1][0]), name))
                elif len(h):
                    self.templates.append(Template(name, np.unique(h), len(h)))
        self.short = {n: (np.array([h for h, _ in sorted(own)], dtype=np.uint64), [name for _, name in sorted(own)]) for n, own in sorted(short.items())}
        self.bands = bands_for(containment, miss)
        self.family = _family(self.bands * ROWS)
        self.classes: list[Class] = []
        for block in sorted({block_of(t.size) for t in self.templates}):
            members = [k for k, t in enumerate(self.templates) if block_of(t.size) == block]
            bands = np.concatenate([self.banded(self.templates[k].shingles) for k in members])
            order = np.argsort(bands, kind="stable")
            known = np.unique(np.concatenate([self.templates[k].shingles for k in members]))
            self.classes.append(Class(block, members, known, bands[order], np.repeat(members, self.bands)[order]))
        # Equal minima mean a common shingle: windows without any shingle of a template share no band.
        self.known = np.unique(np.concatenate([t.shingles for t in self.templates])) if self.templates else np.zeros(0, dtype=np.uint64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def banded(self, shingles: np.ndarray) -> np.ndarray:
        """A number for each band: its place and the minima in it."""
        minima = _signature(shingles, *self.family).reshape(self.bands, ROWS)
        out = np.arange(self.bands, dtype=np.uint64)
        for k in range(ROWS):
            out = mixed(out ^ minima[:, k], 43 + k)
        return out

    def candidates(self, h: np.ndarray, at: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(row, template, first shingle, end) of windows that share a band with a template."""
        out: set[tuple[int, int, int, int]] = set()
        hits = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        hits = hits[np.isin(h[hits], self.known)]
        for c in self.classes:
            own = hits[np.isin(h[hits], c.known)]
            rows = np.searchsorted(at, own, side="right") - 1
            block = (own - at[rows]) // c.block
            windows = {(r, b - back) for r, b in zip(rows.tolist(), block.tolist(), strict=True) for back in (0, 1) if b >= back}
            for row, b in windows:
                start, end = int(at[row]) + b * c.block, min(int(at[row]) + (b + 2) * c.block, int(at[row + 1]))
                bands = self.banded(h[start:end])
                first, last = np.searchsorted(c.bands, bands), np.searchsorted(c.bands, bands, side="right")
                for x, y in zip(first[first < last].tolist(), last[first < last].tolist(), strict=True):
                    out.update((row, k, start, end) for k in c.owners[x:y].tolist())
        return out

    def notices(self, words: Words) -> Iterator[tuple[int, str, int]]:
        """(row, license, first word) of every place where a notice shorter than a shingle stands."""
        if not self.short:
            return
        hashes = words.hashes()
        for n, (known, names) in self.short.items():
            at, h = words.windows(n, hashes)
            hits = np.flatnonzero(np.isin(h, known))
            rows = np.searchsorted(words.offsets, at[hits], side="right") - 1
            for row, place, x in zip(rows.tolist(), at[hits].tolist(), h[hits], strict=True):
                for k in range(int(np.searchsorted(known, x)), int(np.searchsorted(known, x, side="right"))):
                    yield row, names[k], place - int(words.offsets[row])

    def scan(self, texts: Texts) -> list[tuple[int, str, float, int, int]]:
        """(row, license, containment, first word, windows) of every license that a text holds."""
        words = _folded(texts)
        h, at = _shingles(words, self.shingle)
        best: dict[tuple[int, str], tuple[float, int]] = {}
        count: dict[tuple[int, str], int] = {}
        for row, k, start, end in sorted(self.candidates(h, at)):
            t = self.templates[k]
            share = len(np.intersect1d(h[start:end], t.shingles)) / len(t.shingles)
            if share >= self.containment:
                key = (row, t.license)
                first = start - int(at[row])
                best[key] = max(best.get(key, (0.0, 0)), (share, -first))
                count[key] = count.get(key, 0) + 1
        for row, name, first in self.notices(words):
            key = (row, name)
            best[key] = max(best.get(key, (0.0, 0)), (1.0, -first))
            count[key] = count.get(key, 0) + 1
        return [(row, name, share, -first, count[row, name]) for (row, name), (share, first) in sorted(best.items())]


def _run(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = scanner.scan(texts_of(batch.column(1)))
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())], names=["_id", "license", "containment", "first_shingle", "n_windows"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """Licenses whose template a text holds.

    Returns one row per document and license: the id column, license, containment
    (the best share of the template's shingles in one window), first_shingle (where
    that window starts) and n_windows (windows that hold the template). Null and
    empty texts hold none; null ids and repeated rows are reported as they come; a
    template of fewer words than a shingle is looked up over all windows of its
    length, each place counts as a window, with the first word as its start. An
    empty table gives an empty one; other columns are
    not looked at.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, shingle, containment)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_run(scanner), f"_id {kind}, license string, containment double, first_shingle long, n_windows long")
    return out.withColumnRenamed("_id", id_col)
