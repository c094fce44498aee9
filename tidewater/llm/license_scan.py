"""License scans with a generalised suffix automaton.

The automaton of all templates' words gives, for each place in a text, the longest run of words up to
it that stands in some template (matching statistics). Long maximal matches are chained by template,
in the order of both, into spans; a span's score is the share of the template that it covers.
"""

from __future__ import annotations

from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, plain_words

#: Phrases that name a license, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The texts of short public licenses, the notices that long ones ask for, and their labels.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
        details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to
        the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more
        details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
        including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
        Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely
        in the form of machine-executable object code generated by a source language processor.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
        benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
        act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain
        View, CA 94042, USA.""",
}


class SuffixAutomaton:
    """All runs of words of several templates; a state knows where its runs end, as (template, words before the end)."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((t, i + 1))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's run and w, made by splitting if it is not one of its own."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, q)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = self._split(p, w) if p >= 0 else 0
        return new

    def matches(self, words: list[int], at_least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of the matches of ``at_least`` words that go on in neither direction."""
        found, state, n = [], 0, 0
        for i, w in enumerate(words):
            before, run = state, n
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            if n != run + 1 and run >= at_least:
                found.append((i, run, before))
        if n >= at_least:
            found.append((len(words), n, state))
        return found


@cache
def _built(templates: tuple[tuple[str, str], ...]):
    """(label and words of each template, ids of words, automaton)."""
    words = [(label, plain_words(text.encode())) for label, text in templates]
    ids: dict[bytes, int] = {}
    for _, ws in words:
        for w in ws:
            ids.setdefault(w, len(ids))
    return words, ids, SuffixAutomaton([[ids[w] for w in ws] for _, ws in words])


def template_spans(words: list[bytes], templates: tuple[tuple[str, str], ...], at_least: int, gap: int) -> list[tuple[str, int, int, float, bool]]:
    """(label, first word, end, share of the template, best) of the chains of long matches in a text; best: no span over it has a larger share."""
    of, ids, automaton = _built(templates)
    known = np.fromiter(map(ids.get, words, repeat(-1)), np.int32, len(words))
    edge = np.diff(np.concatenate([[False], known >= 0, [False]]).astype(np.int8))
    runs = [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= at_least]
    open_: dict[int, list[int]] = {}  # template: [first word, end, end in the template, words covered]
    spans = []

    def close(t: int) -> None:
        first, end, _, n = open_.pop(t)
        spans.append((of[t][0], first, end, n / len(of[t][1])))

    for a, b in runs:
        for end, n, state in automaton.matches(known[a:b].tolist(), at_least):
            first, end = int(a) + end - n, int(a) + end
            for t, to in sorted(automaton.ends[state]):
                at = open_.get(t)
                if at and first - at[1] <= gap and at[2] < to:
                    more = min(n, to - at[2], end - at[1])
                    if more > 0:
                        open_[t] = [at[0], end, to, at[3] + more]
                elif not at or first >= at[1]:
                    if at:
                        close(t)
                    open_[t] = [first, end, to, n]
    for t in list(open_):
        close(t)
    spans.sort(key=lambda x: (x[1], x[2], x[0]))
    best, over = [True] * len(spans), []
    for i, (_, first, _, share) in enumerate(spans):
        over = [j for j in over if spans[j][2] > first]  # one a template at most
        for j in over:
            best[i] &= spans[j][3] <= share
            best[j] &= spans[j][3] >= share
        over.append(i)
    return [(*x, b) for x, b in zip(spans, best, strict=True)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, at_least: int = 5, gap: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, places (start, label) of the phrases, spans (label, start, end, share, best) of the templates.

    One pass over whole texts, no shuffle. A null or empty text has no words. Rows stand for
    themselves: null or repeated ids are kept, other columns are not looked at, and an empty table gives
    no rows. A text is read once, whatever its length. Of templates that share a run of words each has a
    span of its own; a template's matches that overlap in the text count their words once.
    """
    templates = tuple((templates or TEMPLATES).items())
    named = [(p.encode().split(), label) for p, label in (phrases or PHRASES).items()]

    def scan(batches):
        for batch in batches:
            counts, places, spans = [], [], []
            for text in as_bytes(batch.column(1)):
                words = plain_words(text)
                counts.append(len(words))
                found = []
                for phrase, label in named:
                    at = -1
                    for _ in range(words.count(phrase[-1])):
                        at = words.index(phrase[-1], at + 1)
                        if at + 1 >= len(phrase) and words[at + 1 - len(phrase) : at + 1] == phrase:
                            found.append({"start": at + 1 - len(phrase), "label": label})
                places.append(found)
                spans.append([dict(zip(("label", "start", "end", "share", "best"), x, strict=True)) for x in template_spans(words, templates, at_least, gap)])
            place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64()), ("best", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)], ["doc_id", "n_words", "places", "spans"])

    bounded_batches(docs.sparkSession)
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, places array<struct<start: bigint, label: string>>"
    return docs.select(id_col, text_col).mapInArrow(scan, f"{kinds}, spans array<struct<label: string, start: bigint, end: bigint, share: double, best: boolean>>").withColumnRenamed("doc_id", id_col)


def op1_license_scan(spark, sf_dir: str, enough: float = 0.4) -> DataFrame:
    """The scan's digest of every document; a template's label counts if a span covers ``enough`` of it and more of it than other spans there of theirs. Nulls and empty texts have no words."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda xs: F.array_sort(F.array_distinct(xs))
    base = F.col("places.label")
    own = F.transform(F.filter("spans", lambda x: x["best"] & (x["share"] >= enough)), lambda x: x["label"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.concat_ws(",", labels(base)).alias("base_labels"), F.concat_ws(",", labels(F.concat(base, own))).alias("labels"),
        F.least(F.coalesce(F.array_max("spans.share"), F.lit(0.0)), F.lit(1.0)).alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )
