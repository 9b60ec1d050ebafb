"""Licence scans by the Dice coefficient of word bigrams.

A passage is a run of words of a text; it may begin and end at any word. The sizes prune: with a and b
bigrams, Dice >= t needs b*t/(2-t) <= a <= b*(2-t)/t, and at least b*t/(2-t) shared bigrams. So only places
are looked at from which the largest allowed size holds that many bigrams of the template, and a text that
holds too few bigrams of every template is left at once.

A passage whose first or last bigram is not the template's has a lower Dice than the one without it, so
passages run from one such bigram to another. Of those from one place the best is taken (of equal ones the
shortest).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table, utf8
from .decontaminate import words_of

THRESHOLD = 0.8

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_NAME = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""

#: Fixed texts: public licence texts, file headers and one-line notices, as (licence, template).
TEMPLATES = (
    ("MIT", _MIT_BODY),
    ("ISC", _ISC_BODY),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAME + _BSD_DISCLAIMER),
    ("GPL-2.0", _GPL_HEADER.format(v=2)),
    ("GPL-3.0", _GPL_HEADER.format(v=3)),
    ("Apache-2.0", _APACHE_HEADER),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(x: Counter, y: Counter) -> float:
    """Dice coefficient of two bags of bigrams; 0 if both are empty."""
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


class Templates:
    """Templates with their bigrams and the sizes that can reach the threshold."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.t, self.rows, self.of = threshold, [], {}
        for name, text in templates:
            grams = bigrams(words_of(text.encode()))
            if not grams:
                raise ValueError(f"the template of {name} has fewer than two words")
            for g in grams:
                self.of.setdefault(g, []).append(len(self.rows))
            b = sum(grams.values())
            self.rows.append((name, grams, b, b * threshold / (2 - threshold), b * (2 - threshold) / threshold))
        self.all = frozenset(self.of)

    def _best(self, k: int, words: list[bytes], hits: list[int]) -> Iterator[tuple[float, int, int]]:
        """(Dice, first word, end word) of the best passage for template ``k`` from each of its bigrams' places."""
        _, grams, b, least, most = self.rows[k]
        need = max(1, math.ceil(least - 1e-9))
        if len(hits) < need:
            return
        # a bigram that the template has c times is shared unless its c-th place before lies in the passage too
        earlier, seen = np.full(len(hits), -1, np.int64), {}
        for i, h in enumerate(hits):
            g = (words[h], words[h + 1])
            places = seen.setdefault(g, [])
            if len(places) >= grams[g]:
                earlier[i] = places[-grams[g]]
            places.append(h)
        at = np.array(hits, np.int64)
        first = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] + 1 <= most + 1e-9)
        ends = np.searchsorted(at, at[first] + (most + 1e-9 - 1), side="right")
        for i, j in zip(first.tolist(), ends.tolist(), strict=True):
            size = at[i:j] - at[i] + 1
            scores = 2 * np.cumsum(earlier[i:j] < at[i]) / (size + b)
            x = int(scores.argmax())
            if scores[x] >= self.t:
                yield float(scores[x]), hits[i], hits[i] + int(size[x]) + 1

    def find(self, text: bytes | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first byte, end) of the best passages, none over another, in order."""
        words = words_of(text)
        if self.all.isdisjoint(zip(words, words[1:], strict=False)):
            return []
        places: dict[int, list[int]] = {}
        for i, g in enumerate(zip(words, words[1:], strict=False)):
            for k in dict.fromkeys(self.of.get(g, ())):
                places.setdefault(k, []).append(i)
        found = []
        for k, hits in places.items():
            name, _, b, _, _ = self.rows[k]
            found += [(-score, -b, start, end, name) for score, start, end in self._best(k, words, hits)]
        if not found:
            return []
        out: list = []
        for score, _, start, end, name in sorted(found):
            i = bisect_left(out, (start,))
            if (i == len(out) or end <= out[i][0]) and (i == 0 or out[i - 1][1] <= start):
                insort(out, (start, end, name, -score))
        spans = [m.span() for m in _WORD.finditer(text)]
        return [(name, score, spans[a][0], spans[z - 1][1]) for a, z, name, score in out]


_FOUND = "array<struct<licence: string, dice: double, start: bigint, end: bigint>>"


def scan(docs: DataFrame, out: str, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``out``: the passages that match a template (licence, dice, first byte, end byte in
    UTF-8), none over another, in order of place.

    Whole texts are searched, and passages lie anywhere in a sentence or line. Null, empty and one-word texts
    have no passage. Of passages that overlap the higher Dice stays, then the larger template, then the earlier
    place, then the shorter, then the name. A very long text takes time and memory in proportion to its words.
    Rows and other columns stay, repeated rows too; a column called ``out`` is replaced.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(Templates(templates, threshold))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            rows = (own.find(None if t is None else bytes(t)) for t in batch)
            yield pd.Series([[{"licence": n, "dice": s, "start": a, "end": z} for n, s, a, z in r] for r in rows], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, _FOUND).asNondeterministic()(utf8(F.col(text_col))))


def op2_licences(spark, sf_dir: str) -> DataFrame:
    """Per document: the licence with the highest Dice (ties: first in the text), that value, and all passages."""
    x = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "found")
    best = F.array_max(F.transform("found", lambda f, i: F.struct(f["dice"].alias("dice"), (-i).alias("i"), f["licence"].alias("licence"))))
    text = F.transform("found", lambda f: F.concat_ws(":", f["licence"], f["start"].cast("string"), f["end"].cast("string")))
    return x.select(
        "doc_id", F.size("found").cast("bigint").alias("n_found"), best["licence"].alias("licence"), best["dice"].alias("dice"),
        F.array_join(text, ",").alias("passages"),
    )
