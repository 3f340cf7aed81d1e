"""License scans by winnowed fingerprints and banded alignment.

Templates are word sequences. Hashes of a few words in a row are winnowed (the
least in each run of neighbours stays), and an inverted index leads from such a
fingerprint to the templates and places that have it. Of short templates every
hash is indexed, of as many words as must still stand in a row when the fewest
words that count as covered are left. In a text, shared fingerprints on
neighbouring diagonals make a candidate region; a banded alignment of the template
with that region reports how much of the template is there, and where. Of regions
of one template that overlap, the best covered stays. The index is as large as the
templates, whatever the documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM, NEIGHBOURS = 3, 2
#: Templates of fewer words have all their grams indexed.
WINNOWED_FROM = 20
#: Words that may be put in or left out before an alignment leaves its band, as a
#: share of the template, and at least.
BAND_SHARE, LEAST_BAND = 0.15, 3
LEAST_COVERAGE = 0.8

#: Wordings of notices and licences, as published.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-mention": "Licensed under the Apache License, Version 2.0",
    "mit-mention": "Released under the MIT License",
    "gpl-3.0-mention": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-mention": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "apache-2.0-grant": """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,
non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display,
publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
}
_EDGE = b".,;:!?\"'()[]{}<>*#/-"


def words(text: bytes) -> list[bytes]:
    """Lower-case words of UTF-8, without marks at their ends."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def gram_words(m: int) -> int:
    """Words that stand in a row, at least, where a template of m words has lost as
    many as it may; GRAM at most."""
    need = math.ceil(LEAST_COVERAGE * m)
    return max(1, min(GRAM, -(-need // (m - need + 1))))


@dataclass
class Index:
    names: list[str]
    sequences: list[np.ndarray]  # word ids of each template, from 1
    vocabulary: dict[bytes, int]
    postings: dict[int, dict[int, list[tuple[int, int]]]]  # by gram size: fingerprint to templates and places
    hashes: dict[int, np.ndarray]

    @staticmethod
    def build(templates: dict[str, str]) -> Index:
        vocabulary: dict[bytes, int] = {}
        names, sequences, postings = [], [], defaultdict(lambda: defaultdict(list))
        for name, text in templates.items():
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text.encode())], np.int64)
            if len(ids) < GRAM:
                raise ValueError(f"template {name!r} has fewer than {GRAM} words")
            size = gram_words(len(ids))
            h = grams(ids, size)
            for p in winnowed(h, NEIGHBOURS) if len(ids) >= WINNOWED_FROM else range(len(h)):
                postings[size][int(h[p])].append((len(names), p))
            names.append(name)
            sequences.append(ids)
        return Index(names, sequences, vocabulary, {n: dict(p) for n, p in postings.items()}, {n: np.array(sorted(p), np.int64) for n, p in postings.items()})

    def ids(self, text: bytes) -> np.ndarray:
        """Word ids of a text by white-space-separated word; 0 for unknown ones."""
        split = text.lower().split()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in split), np.int64, len(split))
        for i in np.flatnonzero(ids < 0).tolist():
            ids[i] = get(split[i].strip(_EDGE), 0)
        return ids

    def scan(self, text: bytes) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, words matched, and the span's first and last word and
        number of words) of each region of a text that a template covers."""
        ids = self.ids(text)
        regions: dict[int, set[int]] = defaultdict(set)
        for size, hashes in self.hashes.items():
            h = grams(ids, size)
            for p in np.flatnonzero(np.isin(h, hashes)).tolist():
                for t, place in self.postings[size][int(h[p])]:
                    regions[t].add(p - place)
        out = []
        for t, diagonals in regions.items():
            pattern = self.sequences[t]
            band = band_of(len(pattern))
            found = []
            group: list[int] = []
            for d in [*sorted(diagonals), None]:
                if group and (d is None or d - group[0] > band):
                    best = align(pattern, ids, group[0] - band, group[-1] + band)
                    if best is not None and best[0] >= LEAST_COVERAGE * len(pattern):
                        found.append(best)
                    group = []
                if d is not None:
                    group.append(d)
            # the best covered first, then the shortest, then the first
            taken: list[tuple[int, int, int]] = []
            for n, first, last in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(last < a or first > b for _, a, b in taken):
                    taken.append((n, first, last))
            out += [(self.names[t], n / len(pattern), n, first, last, last - first + 1) for n, first, last in taken]
        return sorted(out, key=lambda x: (x[3], x[0]))


def band_of(m: int) -> int:
    """Diagonals on either side of a fingerprint's that an alignment may use."""
    return max(LEAST_BAND, int(BAND_SHARE * m))


def grams(ids: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of `size` words in a row, by place; exact for 2^21 words."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.int64)
    for j in range(size):
        h = (h << 21) | ids[j : j + n]
    return h


def winnowed(h: np.ndarray, neighbours: int) -> list[int]:
    """Places of the least mixed hash of each run of neighbours, the last of ties."""
    mixed = (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    keep = {max(range(i, min(i + neighbours, len(h))), key=lambda p: (-int(mixed[p]), p)) for i in range(max(1, len(h) - neighbours + 1))}
    return sorted(keep)


def align(pattern: np.ndarray, ids: np.ndarray, lo: int, hi: int) -> tuple[int, int, int] | None:
    """Words of pattern in order within ids, on diagonals lo..hi: (matched, first
    place, last place), with the most matched; of equal ones that which begins
    latest, then ends first. A word of the pattern is a step over the band."""
    m, width = len(pattern), hi - lo + 1
    steps = np.arange(width)
    text = np.zeros(width + m, np.int64)  # the band's places from lo on; 0 outside the text
    a, b = max(lo, 0), min(len(ids), hi + m)
    if b > a:
        text[a - lo : b - lo] = ids[a:b]
    size = width + m + 1
    state = np.zeros(width, np.int64)  # matched * size + (first place - lo + 1)
    ends = np.full(width, -1, np.int64)
    for i in range(m):
        hit = text[i : i + width] == pattern[i]
        fresh = np.where(state > 0, state + size, size + i + steps + 1)
        new, last = np.where(hit, fresh, state), np.where(hit, i + steps, ends)
        # a word of the pattern left out comes from the next diagonal
        more = state[1:] > new[:-1]
        new[:-1] = np.where(more, state[1:], new[:-1])
        last[:-1] = np.where(more, ends[1:], last[:-1])
        # words put into the text go along the band: the best so far, the first of equals
        key = np.maximum.accumulate(new * width + (width - 1 - steps))
        at = width - 1 - key % width
        state, ends = key // width, last[at]
    top = max(range(width), key=lambda d: (state[d], -ends[d]))
    if not state[top]:
        return None
    matched, first = divmod(int(state[top]), size)
    return matched, first - 1 + lo, int(ends[top]) + lo


FOUND = "license string, coverage double, matched int, first_word long, last_word long, span_words long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage (share of the template's words), matched, first_word,
    last_word (places among white-space-separated words, from 0), span_words, for
    each region of a document that a template covers to LEAST_COVERAGE or more.

    Null and empty texts have none; a text of any length is scanned whole. Of regions
    of one template that overlap, the best covered stays, of equal ones the shortest,
    then the first; regions of different templates may overlap. Null doc_ids are
    carried; repeated rows give repeated rows; other columns are ignored; an empty
    table has no regions.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(Index.build(templates or TEMPLATES))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(c: dict[str, list]) -> dict[str, list]:
        names = ("doc_id", *(x.split()[0] for x in FOUND.split(", ")))
        out: dict[str, list] = {n: [] for n in names}
        for doc, text in zip(c["doc_id"], c["text"], strict=True):
            for found in shared.value.scan(text):
                for n, v in zip(names, (doc, *found), strict=True):
                    out[n].append(v)
        return out

    return common.map_rows(rows, f"doc_id {kind}, {FOUND}", run, binary=("text",))
