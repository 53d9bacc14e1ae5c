"""Licence scans with a generalised suffix automaton over licence words.

Templates are word sequences; one automaton recognises every run of words of any
template.  A file is streamed through it and yields matching statistics: at each word
the length of the longest run that ends there and occurs in a template.  Maximal runs
of MIN_RUN words or more become (file, template) matches, which are chained in order
along each template over gaps of GAP_MOST words at most; the share of a template's words that the best chain covers is
its score.  Words of most texts occur in no template run, so only stretches whose
adjacent word pairs all occur in a template are walked.

Defined cases: null and empty texts have no words, no labels and score 0; texts are
scanned whole, very long ones too, in slices of rows; repeated rows are scanned each; equal
chains prefer the earlier one; further columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textassay.llm.textops import ALNUM_WORDS, hash_words, slices

MIN_RUN = 4
#: Share of a template that must be covered for its label.
COVERED = 0.6
#: Words, of the file or of the template, that may stand between two runs of a span.
GAP_MOST = 40

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public licence notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


class SuffixAutomaton:
    """Of several token sequences; each state knows where its longest run ends in them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._add(last, token)
                self.ends[last].append((k, i))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []
        self.ends = [sorted(set(e)) for e in self.ends]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, at: int, token: int) -> int:
        """The state that reads `token` after state `at` and holds exactly one token more than it."""
        target = self.next[at][token]
        if self.length[target] == self.length[at] + 1:
            return target
        twin = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while at >= 0 and self.next[at].get(token) == target:
            self.next[at][token] = twin
            at = self.link[at]
        return twin

    def _add(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, token)
        return new

    def runs(self, tokens, least: int):
        """(first, length, state) of each maximal run of at least `least` tokens that occurs in a sequence."""
        state = length = 0
        for i, token in enumerate(tokens):
            if token not in self.next[state]:
                if length >= least:
                    yield i - length, length, state
                while state and token not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state = length = 0
        if length >= least:
            yield len(tokens) - length, length, state


class Scanner:
    def __init__(self, templates=TEMPLATES):
        words = [template_words(t) for _, t in templates]
        self.labels, self.sizes = [label for label, _ in templates], [len(w) for w in words]
        known = sorted({w for t in words for w in t})
        hashes = hash_words([w.encode() for w in known])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {known[k]: i for i, k in enumerate(order)}
        sequences = [[number[w] for w in t] for t in words]
        self.automaton = SuffixAutomaton(sequences)
        self.pairs = np.unique([a * len(known) + b for s in sequences for a, b in zip(s[:-1], s[1:], strict=True)])
        self.phrases = [(hash_words([w.encode() for w in phrase.split()]), label) for phrase, label in PHRASES]

    def base(self, words):
        """(word number, label) arrays of the phrase places of a slice."""
        h = words.hash
        last = np.repeat(words.rows[1:], words.count)
        places, labels = [], []
        for phrase, label in self.phrases:
            at = np.flatnonzero(h == phrase[0])
            at = at[at + len(phrase) <= last[at]] if len(at) else at
            for k in range(1, len(phrase)):
                at = at[h[at + k] == phrase[k]]
            places.append(at)
            labels += [label] * len(at)
        return np.concatenate(places), labels

    def covered(self, words):
        """row -> matches (first word, words, template, first template word) of the runs of a slice."""
        if len(words.hash) < MIN_RUN:
            return {}
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        known = self.hashes[at] == words.hash
        pair = at[:-1] * len(self.hashes) + at[1:]
        ok = known[:-1] & known[1:]
        ok &= self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        inner = words.rows[1:-1]
        ok[inner[(inner > 0) & (inner <= len(ok))] - 1] = False
        edges = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b in zip(begin, end, strict=True):
            if b - a + 1 < MIN_RUN:
                continue
            row = int(np.searchsorted(words.rows, a, side="right")) - 1
            for first, size, state in self.automaton.runs(at[a : b + 1].tolist(), MIN_RUN):
                for template, last in self.automaton.ends[state]:
                    found.setdefault(row, []).append((int(a) + first - int(words.rows[row]), size, template, last - size + 1))
        return found

    def chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, covered words, first word, last word) of the best chain of each template."""
        out = []
        for template in sorted({m[2] for m in matches}):
            own = sorted(m for m in matches if m[2] == template)
            longest = max(m[1] for m in own)
            best: list[tuple[int, int]] = []  # covered words, first word of the chain
            for i, (f, n, _, t) in enumerate(own):
                score = (n, f)
                for j in range(i - 1, -1, -1):
                    g, m, _, u = own[j]
                    if f - g > GAP_MOST + longest:
                        break  # what begins earlier ends too far away
                    gain = n - max(0, g + m - f, u + m - t)  # overlaps count once
                    if g < f and u < t and gain > 0 and t - u - m <= GAP_MOST and f - g - m <= GAP_MOST and best[j][0] + gain > score[0]:
                        score = (best[j][0] + gain, best[j][1])
                best.append(score)
            k = max(range(len(own)), key=lambda i: (best[i][0], -i))
            out.append((template, best[k][0], best[k][1], own[k][0] + own[k][1] - 1))
        return out


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of docs(doc_id, text).

    spans: the covered stretch of each template whose label is given.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))

    def run(batches):
        own = scanner()
        for batch in batches:
            for part in slices(batch.column("text")):
                words = part.words(ALNUM_WORDS, lower=True)
                at, label = own.base(words)
                row = np.searchsorted(words.rows, at, side="right") - 1
                n_base = np.bincount(row, minlength=part.n)
                first, last = [None] * part.n, [None] * part.n
                base: list[set[str]] = [set() for _ in range(part.n)]
                for w, r, name in sorted(zip((at - words.rows[row]).tolist(), row.tolist(), label, strict=True)):
                    first[r] = w if first[r] is None else first[r]
                    last[r] = w
                    base[r].add(name)
                added: list[set[str]] = [set() for _ in range(part.n)]
                score = np.zeros(part.n)
                spans: list[list[dict]] = [[] for _ in range(part.n)]
                for r, found in own.covered(words).items():
                    for template, n, a, z in own.chains(found):
                        share = min(1.0, n / own.sizes[template])
                        score[r] = max(score[r], share)
                        if share >= COVERED:
                            added[r].add(own.labels[template])
                            spans[r].append({"label": own.labels[template], "first": a, "last": z, "covered": share})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.first, part.n),
                        pa.array(words.count.astype(np.int64)),
                        pa.array(n_base.astype(np.int64)),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                        pa.array([",".join(sorted(b)) for b in base]),
                        pa.array([",".join(sorted(b | a)) for b, a in zip(base, added, strict=True)]),
                        pa.array(score),
                        pa.array(spans, span_type),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first: bigint, last: bigint, covered: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
