"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports spans.

A text's words are runs of letters and digits, A-Z lower-cased.  Its fingerprints are the
smallest of each WINDOW neighbouring word n-grams' hashes, so any stretch of
GRAM + WINDOW - 1 words that a text shares with a template gives both a common
fingerprint.  The templates' fingerprints form an inverted index; the hits of one template near one
diagonal pick a candidate passage, and Smith-Waterman alignment in a band about
them reports which share of the template's words match, and where.

The index holds the templates only; it is broadcast up to MAX_TEMPLATE_WORDS words, in blocks of that beyond.

Defined results: null and empty texts match nothing; templates without words match
nothing, and those shorter than the guarantee are found if they have a fingerprint in
common, an exact copy always; where matches of one group of templates overlap,
the one with the most matching words stays (then the higher coverage, then the
first name); equal rows match alike; empty tables give an empty result; other columns are
ignored.  A very long text is hashed in chunks; alignment holds two rows of a band as wide as a quarter of the template.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .alignment import MATCH, clusters, smith_waterman
from .tables import narrow_batches, table
from .tokens import PUNCTUATION, mix, words

GRAM = 3
WINDOW = 2
COVERAGE = 0.8
MAX_TEMPLATE_WORDS = 1 << 20
FILTER_BITS = 20

# Public license notices and texts, as (name, group): text.
TEMPLATES: dict[tuple[str, str], str] = {
    ("MIT-notice", "MIT"): "Released under the MIT License.",
    ("MIT-licensed", "MIT"): "Licensed under the MIT License.",
    ("MIT", "MIT"): """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ("ISC", "ISC"): """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ("BSD-conditions", "BSD"): """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ("BSD-notice", "BSD"): "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ("Zlib", "Zlib"): """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    ("Unlicense", "Unlicense"): """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ("Apache-2.0-notice", "Apache-2.0"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "Apache-2.0"): """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ("GPL-3.0-notice", "GPL"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-3.0", "GPL"): """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ("MPL-2.0", "MPL"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ("CC-BY-NC-4.0-notice", "CC"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-4.0-notice", "CC"): "Licensed under CC BY 4.0.",
    ("CC-BY-SA-4.0-notice", "CC"): "Licensed under CC BY-SA 4.0.",
    ("CC0-1.0", "CC"): "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ("BSD-3-Clause", "BSD"): """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ("LGPL", "GPL"): """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ("AGPL-3.0", "GPL"): """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    ("EPL-2.0", "EPL"): """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    ("BSL-1.0", "BSL"): """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    ("All-rights-reserved", "proprietary"): "All rights reserved. No part of this publication may be reproduced without prior written permission.",
}


def _grams(h: np.ndarray) -> np.ndarray:
    n = min(GRAM, len(h))
    out = np.zeros(max(0, len(h) - n + 1) if n else 0, dtype=np.uint64)
    for k in range(n):
        out = mix(out ^ h[k : len(h) - n + 1 + k])
    return out


def winnowed(grams: np.ndarray) -> np.ndarray:
    """The places of the smallest of each WINDOW neighbouring n-grams, the first of equals."""
    if len(grams) < WINDOW:
        return np.arange(len(grams))
    low = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(1) + np.arange(len(grams) - WINDOW + 1)
    return np.unique(low)


class Index:
    """The inverted index: sorted fingerprints with their template and place."""

    def __init__(self, templates: Mapping[tuple[str, str], str]):
        self.names = list(templates)
        self.words = [next(w.hashes for _, _, w in words(pa.array([t], pa.string()), lower=True, separators=PUNCTUATION)) for t in templates.values()]
        grams = [_grams(h) for h in self.words]
        places = [winnowed(g) for g in grams]
        found = np.concatenate([g[p] for g, p in zip(grams, places, strict=True)]) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(found, kind="stable")
        self.hash = found[order]
        self.template = np.repeat(np.arange(len(grams)), [len(p) for p in places])[order]
        self.place = np.concatenate(places)[order] if places else np.zeros(0, dtype=np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.hash >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def scan(self, h: np.ndarray, g: np.ndarray, coverage: float) -> list[tuple[int, int, int, int, int]]:
        """(template, first word, end, score, matches) in a text with word hashes h and n-gram hashes g."""
        near = np.flatnonzero(self.filter[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, g[near], side="left"), np.searchsorted(self.hash, g[near], side="right")
        near, lo, hi = near[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(near):
            return []
        # a hit that the text's own winnowing does not choose is no fingerprint of it
        own = np.zeros(len(near), dtype=bool)
        for k in range(WINDOW):
            left = near - k
            right = left + WINDOW
            ok = (left >= 0) & (right <= len(g))
            view = np.array([[g[x + d] if 0 <= x + d < len(g) else np.uint64(2**64 - 1) for d in range(WINDOW)] for x in left], dtype=np.uint64)
            own |= ok & (view.argmin(1) == k)
        own |= len(g) < WINDOW
        near, lo, hi = near[own], lo[own], hi[own]
        if not len(near):
            return []
        pick = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        template, diagonal = self.template[pick], np.repeat(near, hi - lo) - self.place[pick]
        out = []
        for t in np.unique(template):
            d, x = diagonal[template == t], self.words[t]
            band = len(x) // 8 + 2
            for run in clusters(d, band):
                first, last = int(d[run].min()), int(d[run].max())
                a, b = max(0, first - band), min(len(h), last + len(x) + band)
                found = smith_waterman(x, h[a:b], centre=(first + last) // 2 - a, band=band + (last - first + 1) // 2)
                if found.matches >= coverage * len(x):
                    out.append((int(t), a + found.other_start, a + found.other_end, found.score, found.matches))
        return self._best(out)

    def _best(self, found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        out: list[tuple[int, int, int, int, int]] = []
        for f in sorted(found, key=lambda f: (-f[4], -f[4] / len(self.words[f[0]]), self.names[f[0]], f[1])):
            if all(f[2] <= o[1] or o[2] <= f[1] or self.names[f[0]][1] != self.names[o[0]][1] for o in out):
                out.append(f)
        return sorted(out, key=lambda f: f[1])


def indexes(templates: Mapping[tuple[str, str], str]) -> Iterator[Index]:
    block: dict[tuple[str, str], str] = {}
    size = 0
    for k, t in templates.items():
        block[k] = t
        size += len(t.split())
        if size > MAX_TEMPLATE_WORDS:
            yield Index(block)
            block, size = {}, 0
    if block:
        yield Index(block)


def scan(docs: DataFrame, templates: Mapping[tuple[str, str], str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, template, license, first_word, end_word, score, coverage) for each passage of docs that is of a template."""
    spark = docs.sparkSession
    narrow_batches(spark)
    schema = docs.select("doc_id").schema.add("template", "string").add("license", "string").add("first_word", "long").add("end_word", "long").add("score", "double").add("coverage", "double")
    result = spark.createDataFrame([], schema)

    def find(index: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                rows = []
                for at, _, w in words(b.column(1), lower=True, separators=PUNCTUATION):
                    g = _grams(w.hashes)
                    hit = np.flatnonzero(ix.filter[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    texts = np.unique(np.searchsorted(w.first, hit, side="right") - 1)
                    short = np.flatnonzero(np.diff(w.first) < GRAM)
                    for i in np.union1d(texts, short[np.diff(w.first)[short] > 0]).tolist():
                        x, y = int(w.first[i]), int(w.first[i + 1])
                        h = w.hashes[x:y]
                        for t, s, e, score, m in ix.scan(h, g[x : y - GRAM + 1] if y - x >= GRAM else _grams(h), coverage):
                            rows.append((at + i, *ix.names[t], s, e, score / (MATCH * len(ix.words[t])), m / len(ix.words[t])))
                own = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([own, *(pa.array([r[i + 1] for r in rows], k) for i, k in enumerate(kinds))], names=schema.names)

        return run

    for ix in indexes(TEMPLATES if templates is None else templates):
        result = result.union(docs.select("doc_id", "text").mapInArrow(find(spark.sparkContext.broadcast(ix)), schema))
    return result


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES: dict[str, str] = {}
