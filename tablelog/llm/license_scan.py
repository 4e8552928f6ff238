"""License scan by patience alignment with templates.

A template is aligned to a region of a text: words that occur once in both are
anchors, the longest increasing subsequence of their places is kept, and the
gaps between kept anchors are aligned in the same way; a gap without anchors
gives the equal words at its ends.  Coverage is the share of the template's
words that are aligned.

Where in a text a template may lie is found by the longest chain of words that the
template has once, in its order, wherever they stand; the text before and behind what
was found is searched again, so a text may hold a license several times.

Templates whose words a text lacks too many of are skipped: coverage can't be
more than the words they share.  A template with key phrases (version, Lesser,
NC, a clause) needs them in its span, and of templates that align mostly the
same words of a text the one with the most aligned words is kept.

Defined results: null and empty texts hold no license; spans are in words, end
exclusive; spans of templates that align other words may overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelog.llm.common import small_batches
from tablelog.llm.license_texts import TEXTS

COVERAGE = 0.8

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_NO_ENDORSEMENT = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the copyright holder. 4. """
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all copies"""
_ISC_DISCLAIMER = """. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""


def _gnu_header(kind: str, version: str, work: str = "program") -> str:
    """Notice that the GNU licenses ask to put at the start of each file."""
    return f"""This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public
License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."""


#: Fixed texts of public licenses and of the notices that refer to them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": _ISC + _ISC_NOTICE + _ISC_DISCLAIMER,
    "0BSD": _ISC + _ISC_DISCLAIMER,
    "BSD-2-Clause": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD + "3. " + _NO_ENDORSEMENT + _BSD_DISCLAIMER,
    "BSD-4-Clause": _BSD + _ADVERTISING + _NO_ENDORSEMENT + _BSD_DISCLAIMER,
    **TEXTS,
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-2.0-header": _gnu_header("General", "2"),
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0-header": _gnu_header("General", "3"),
    "LGPL-2.1-header": _gnu_header("Lesser General", "2.1", "library"),
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-header": _gnu_header("Lesser General", "3"),
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0-header": _gnu_header("Affero General", "3"),
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
}

#: Phrases that a text must hold where a template lies, as near relatives share most of the other words.
KEYS = {
    "ISC": ["provided that the above copyright notice"],
    "BSD-3-Clause": ["neither the name of"],
    "BSD-4-Clause": ["all advertising materials", "neither the name of"],
    "Apache-2.0": ["apache license version 2.0"],
    "GPL-2.0": ["gnu general public license version 2"],
    "GPL-3.0": ["gnu general public license version 3"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1"],
    "LGPL-3.0": ["gnu lesser general public license version 3"],
    "MPL-2.0": ["mozilla public license version 2.0"],
    "Apache-2.0-header": ["apache license version 2.0"],
    "MIT-notice": ["mit license"],
    "Apache-2.0-notice": ["apache license version 2.0"],
    "CC-BY-NC-4.0-notice": ["cc by-nc 4.0"],
    "CC-BY-4.0-notice": ["cc by 4.0"],
    "GPL-2.0-header": ["gnu general public license as published", "version 2 of the license"],
    "GPL-2.0-notice": ["gnu general public license version 2"],
    "GPL-3.0-header": ["gnu general public license as published", "version 3 of the license"],
    "GPL-3.0-notice": ["gnu general public license version 3"],
    "LGPL-2.1-header": ["gnu lesser general public license as published", "version 2.1 of the license"],
    "LGPL-2.1-notice": ["gnu lesser general public license version 2.1"],
    "LGPL-3.0-header": ["gnu lesser general public license as published", "version 3 of the license"],
    "LGPL-3.0-notice": ["gnu lesser general public license version 3"],
    "AGPL-3.0-header": ["gnu affero general public license as published", "version 3 of the license"],
    "AGPL-3.0-notice": ["gnu affero general public license version 3"],
}

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        p = bisect_left(tails, v)
        before[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(v)
            at.append(k)
        else:
            tails[p], at[p] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) places, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if in_template[w] == 1}
        pairs = [(k, place[w]) for k, w in enumerate(text[a:b], a) if in_text[w] == 1 and w in place]
        kept = [pairs[k] for k in _increasing([q for _, q in pairs])]
        for p, q in kept:
            todo.append((a, p, c, q))
            out.append((p, q))
            a, c = p + 1, q + 1
        if kept:
            todo.append((a, b, c, d))
    return sorted(out)


class Matcher:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, keys: dict[str, list[str]] = KEYS):
        self.coverage = coverage
        self.templates = []
        for name, t in templates.items():
            if w := words_of(t):
                count = Counter(w)
                single = {x: k for k, x in enumerate(w) if count[x] == 1}
                self.templates.append((name, w, count, single, [f" {k} " for k in keys.get(name, ())]))

    def licenses(self, text: str | None) -> list[dict]:
        words = words_of(text)
        has = Counter(words)
        found = []
        for name, own, count, single, keys in self.templates:
            need = self.coverage * len(own)
            if len(words) < need or sum(min(n, has[w]) for w, n in count.items()) < need:
                continue
            for start, end, places in self._occurrences(words, own, single, need):
                if keys and not all(k in f" {' '.join(words[start:end])} " for k in keys):
                    continue
                found.append(({"name": name, "start": start, "end": end, "coverage": len(places) / len(own)}, places))
        # the same words aligned to several templates are the one that explains most of them
        found.sort(key=lambda x: (-len(x[1]), -x[0]["coverage"], x[0]["name"]))
        kept: list[tuple[dict, set[int]]] = []
        for span, places in found:
            if all(2 * len(places & other) <= len(places) for _, other in kept):
                kept.append((span, places))
        return sorted((span for span, _ in kept), key=lambda x: (x["start"], x["end"], x["name"]))

    def _occurrences(self, words: list[str], own: list[str], single: dict[str, int], need: float) -> Iterator[tuple[int, int, set[int]]]:
        """(start, end, aligned places) of each part of the text that covers enough of a template.

        Of the template's single words, wherever they stand in a part of the text,
        the longest chain in the template's order says where the template lies;
        foreign words between them are as many as they are, and in proportion at the ends.  What it misses may be no
        more than the template may lack.  A part is searched again on both sides of
        what was found, or of the widest gap in a chain that came to nothing.
        """
        least = max(1, len(single) - (len(own) - need))
        todo = [(0, len(words))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < need:
                continue
            hits = [(p, single[words[p]]) for p in range(lo, hi) if words[p] in single]
            chain = [hits[k] for k in _increasing([q for _, q in hits])]
            if len(chain) < least:
                continue
            (p, q), (r, t) = chain[0], chain[-1]
            rate = (r - p) / max(1, t - q)  # words of the text for a word of the template
            a, b = max(lo, p - ceil(rate * q) - 2), min(hi, r + ceil(rate * (len(own) - t)) + 2)
            pairs = patience(words[a:b], own)
            if len(pairs) >= need:
                start, end = a + pairs[0][0], a + pairs[-1][0] + 1
                yield start, end, {a + k for k, _ in pairs}
                todo += [(lo, start), (end, hi)]
            elif len(chain) > 1:
                cut = max(range(1, len(chain)), key=lambda k: chain[k][0] - chain[k - 1][0])
                todo += [(lo, chain[cut - 1][0] + 1), (chain[cut][0], hi)]


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """(id, licenses): spans of the templates that each text holds; no rows move between tasks."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, coverage)
        for b in batches:
            found = [matcher.licenses(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, kind)], names=["id", "licenses"])

    schema = f"id {source.schema['id'].dataType.simpleString()}, licenses array<struct<name:string,start:bigint,end:bigint,coverage:double>>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(spans, ",").alias("licenses"))
