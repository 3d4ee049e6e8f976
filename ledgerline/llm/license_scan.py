"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

A template's words give hashes of all runs of `GRAM` words. They are winnowed: of every `window` neighbours the least is
kept, in an inverted index (hash -> template and place). Any run of a text is looked up in it. The window is chosen for
each template so that a hit is certain: an edit of one word spoils only kept runs that hold the word, so as many kept runs
that share no word as there are words to lose below `LEAST`, and one more, cannot all be spoilt. The largest such window
is taken; if there is none for runs of `GRAM` words, shorter runs are used. So every copy in which words are replaced or
removed is looked at, as long as its coverage can reach `LEAST`. Words put in between lose no coverage but spoil runs; a
copy with a word put in after every second one or less has no hit (the tests measure the recall of such copies).

Hits on near diagonals make a candidate. Unless it has too few of the template's words by count, it is aligned inside the
band of its diagonals, widened by the gaps that are allowed. Reported are the matched words, their share of the template
(coverage) and the spans on both sides, where coverage is `LEAST` or more. A template of fewer than `SHORT` words is found
only word for word, as with one word changed it may say something else.

Where templates overlap in a text (a line inside a notice, sibling licences), the one with the most matched words counts,
then that with the higher coverage.

The templates are a parameter. The default ones are licences and short notices written here from their public wording.

Cases: null and empty texts match nothing; null ids are carried along; repeated rows are all reported; a template without
words is ignored; of templates with the same words the first by name is reported; an empty table gives an empty result;
further columns are not read. A text that holds a template twice gives two rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.align import MATCH, Alignment, disjoint, local_alignment, most_shared, plain_words
from ledgerline.llm.common import WordHashes, id_and_text, read_table, shingle_sequence, slices

GRAM = 3
#: Windows that are tried, the largest first.
WINDOWS = (8, 6, 4, 3, 2, 1)
LEAST = 0.75
#: Templates of fewer words match word for word only.
SHORT = 8

TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT line": "under the MIT License",
    "GPL line": "under the GNU General Public License",
    "CC-BY line": "Licensed under CC BY 4.0",
    "CC-BY-NC line": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA line": "Licensed under CC BY-SA 4.0",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-2.0-or-later notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0-or-later notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "All rights reserved": "All rights reserved",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Warranty disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
}


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the hashes that are the least (the last of equals) of some `window` neighbours; of fewer hashes, the least."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(hashes[::-1].argmin())])
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + (window - 1) - runs.argmin(1))


def apart(places: np.ndarray, size: int) -> int:
    """As many of the runs of `size` words at these places as share no word."""
    count, end = 0, 0
    for p in places.tolist():
        if p >= end:
            count, end = count + 1, p + size
    return count


def fingerprints(codes: np.ndarray, lost: int, windows: tuple[int, ...] = WINDOWS) -> tuple[int, np.ndarray, np.ndarray]:
    """(words of a run, kept hashes, their places) such that an edit of `lost` words leaves one of them whole."""
    for size in range(min(GRAM, len(codes)), 0, -1):
        hashes = shingle_sequence(codes, size)
        for window in windows:
            places = winnowed(hashes, window)
            if apart(places, size) > lost:
                return size, hashes[places], places
    raise ValueError("more words may be lost than there are")


class Index:
    """The inverted index of the templates' kept hashes, by the words of a run."""

    def __init__(self, templates: dict[str, str], least: float = LEAST) -> None:
        self.hashes, self.least = WordHashes(), least
        self.names, self.words, self.bounds = [], [], []
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in sorted(templates.items()):
            words = plain_words(text)
            if not words:
                continue
            codes = self.hashes.array(words)
            lost = 0 if len(words) < SHORT else len(words) - math.ceil(least * len(words) - 1e-9)
            size, kept, at = fingerprints(codes, lost)
            for gram, place in zip(kept.tolist(), at.tolist()):
                self.places[size][gram].append((len(self.names), place))
            self.names.append(name)
            self.words.append(codes.view(np.int64))
            self.bounds.append(most_shared(self.words[-1]))
        self.sorted = {size: np.array(sorted(grams), np.uint64) for size, grams in self.places.items()}
        self.tables = {}
        for size, grams in self.sorted.items():
            self.tables[size] = np.zeros(1 << 16, bool)
            self.tables[size][(grams >> np.uint64(48)).astype(np.int64)] = True

    def _hits(self, codes: np.ndarray) -> dict[int, list[int]]:
        """template -> where it would start in the text, of every kept hash in the text."""
        hits: dict[int, list[int]] = defaultdict(list)
        for size, known in self.sorted.items():
            grams = shingle_sequence(codes, size)
            at = np.flatnonzero(self.tables[size][(grams >> np.uint64(48)).astype(np.int64)])
            kept = grams[at]
            place = np.searchsorted(known, kept)
            place[place == len(known)] = 0
            for i in np.flatnonzero(known[place] == kept).tolist():
                for template, t in self.places[size][int(kept[i])]:
                    hits[template].append(int(at[i]) - t)
        return hits

    def matches(self, text: str) -> list[tuple]:
        """(template, coverage, matched, first and end word in the text, first and end word in the template) of every template."""
        codes = self.hashes.array(plain_words(text)).view(np.int64)
        out = []
        for template, found in self._hits(codes.view(np.uint64)).items():
            query, n = self.words[template], len(self.words[template])
            if n < SHORT:
                found = [Alignment(MATCH * n, n, 0, n, s, s + n) for s in sorted(set(found)) if 0 <= s <= len(codes) - n and (codes[s : s + n] == query).all()]
            else:
                found = self._aligned(template, sorted(set(found)), codes)
            for x in disjoint(sorted(found, key=lambda x: (-x.score, x.b_start))):
                out.append((self.names[template], x.matched / n, x.matched, x.b_start, x.b_end, x.a_start, x.a_end))
        return sorted(out, key=lambda x: (x[3], x[0]))

    def _aligned(self, template: int, starts: list[int], codes: np.ndarray) -> list[Alignment]:
        """The best alignment of each cluster of near diagonals, inside its band."""
        query, bound = self.words[template], self.bounds[template]
        n, needed = len(query), self.least * len(query) - 1e-9
        slack = max(6, n // 4)
        out, i = [], 0
        while i < len(starts):
            first = starts[i]
            while i + 1 < len(starts) and starts[i + 1] - first <= min(2 * slack, n // 2):
                i += 1
            last, i = starts[i], i + 1
            low, high = max(0, first - slack), min(len(codes), last + n + slack)
            part = codes[low:high]
            if bound(part) >= needed:
                x = local_alignment(query, part, first - slack - low, last + slack - low)
                if x.matched >= needed:
                    out.append(x._replace(b_start=low + x.b_start, b_end=low + x.b_end))
        return out

    def best(self, text: str) -> list[tuple]:
        """The matches without those of which half or more is covered by one with more matched words or, of as many, higher coverage."""
        starts: list[int] = []
        out: list[tuple] = []
        for x in sorted(self.matches(text), key=lambda x: (-x[2], -x[1], x[3], x[0])):
            i, half = bisect_left(starts, x[3]), (x[4] - x[3]) / 2
            near = out[max(0, i - 2) : i + 2]
            if all(min(x[4], y[4]) - max(x[3], y[3]) < half for y in near):
                starts.insert(i, x[3])
                out.insert(i, x)
        return out


FOUND = "doc_id long, template string, coverage double, matched long, start_word long, end_word long, template_start long, template_end long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """A row for each place of a document that holds a template: the best one there."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, least)
        for batch in slices(batches):
            found = [(doc, *x) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in index.best(text)]
            cols = list(zip(*found)) if found else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in FOUND.split(", ")])

    return id_and_text(docs).mapInArrow(run, FOUND)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in a document, with its coverage and place."""
    return scan(read_table(spark, sf_dir, "documents"))
