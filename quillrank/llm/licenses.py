"""License scans by patience alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import table

COVERAGE = 0.8
TOKEN = re.compile(r"\w+")

#: The notices and license texts to look for, by their SPDX names.
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL_NOTICE = "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "GPL-2.0": [f"This program is free software; {_GPL_NOTICE.format('General Public License', '2')}"],
    "LGPL-2.1": [f"This library is free software; {_GPL_NOTICE.format('Lesser General Public License', '2.1')}"],
    "LGPL-3.0": [f"This library is free software: {_GPL_NOTICE.format('Lesser General Public License', '3')}"],
    "AGPL-3.0": [f"This program is free software: {_GPL_NOTICE.format('Affero General Public License', '3')}"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        f"This program is free software: {_GPL_NOTICE.format('General Public License', '3')}",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": [_BSD_START, f"{_BSD_START}: {_BSD_CLAUSES}{_BSD_THIRD}{_BSD_END}"],
    "BSD-2-Clause": [f"{_BSD_START}: {_BSD_CLAUSES}{_BSD_END}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs``, sorted by first, whose seconds rise."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        tails[p : p + 1], at[p : p + 1] = [j], [k]
    k, out = (at[-1] if at else -1), []
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Pairs of positions of equal words of ``a`` and ``b`` in order.

    Patience: words that occur once in each are anchors, the longest rising run of them is taken, and the gaps
    around them are aligned the same way after their equal ends are taken off.
    """
    out: list[tuple[int, int]] = []
    work = [(a0, len(a), b0, len(b))]
    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        ca, cb = Counter(a[i:n]), Counter(b[j:m])
        where = {w: k for k, w in enumerate(b[j:m], j) if cb[w] == 1}
        anchors = rising([(k, where[a[k]]) for k in range(i, n) if ca[a[k]] == 1 and a[k] in where])
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (n, m)], strict=True):
            if r - p > 1 and s - q > 1:
                work.append((p + 1, r, q + 1, s))
    return sorted(out)


class Templates:
    """Templates with an index from pairs of neighbouring words to the places they stand."""

    def __init__(self, templates: dict[str, list[str]]):
        self.rows = [(name, TOKEN.findall(t.lower())) for name, ts in templates.items() for t in ts]
        self.codes = {w: k for k, w in enumerate(sorted({w for _, ws in self.rows for w in ws}))}
        self.pairs: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, (_, ws) in enumerate(self.rows):
            for k in range(len(ws) - 1):
                self.pairs[self.codes[ws[k]] * len(self.codes) + self.codes[ws[k + 1]]][t].append(k)
        self.keys = np.array(sorted(self.pairs), np.int64)

    def regions(self, words: list[str], least: float = COVERAGE) -> list[tuple[int, int, int]]:
        """``(template, from, to)``: windows that may hold a place of a template; they overlap, and the alignment decides.

        A place matches ``m`` of a template's ``s`` words, ``m`` and ``m / span`` at least ``least``, so at most ``s * (1 - least)`` words
        are left out and ``s * (1 / least - 1)`` come between. Each of these parts two neighbours at most, so ``s * (3 * least - 2) - 1``
        neighbouring pairs at least are whole, and their starts (place in the text less place in the template) lie within the sum of
        the two. A pair that so many others of different places are near gives a window that covers any such place around it.
        """
        code = np.fromiter((self.codes.get(w, -1) for w in words), np.int64, len(words))
        pair = np.where((code[:-1] >= 0) & (code[1:] >= 0), code[:-1] * len(self.codes) + code[1:], -1)
        seen = np.flatnonzero(np.isin(pair, self.keys)) if len(pair) else ()
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in seen:
            for t, places in self.pairs[int(pair[p])].items():
                hits[t] += [(int(p) - k, k) for k in places]
        out = []
        for t, found in hits.items():
            size = len(self.rows[t][1])
            more, less = ceil(size * (1 / least - 1)), ceil(size * (1 - least))
            need = max(1, ceil(round(size * (3 * least - 2) - 1, 6)))
            found.sort()
            near: Counter[int] = Counter()
            low = high = 0
            for n, (start, _) in enumerate(found):
                while high < len(found) and found[high][0] <= start + more + less:
                    near[found[high][1]] += 1
                    high += 1
                while found[low][0] < start - more - less:
                    near[found[low][1]] -= 1
                    if not near[found[low][1]]:
                        del near[found[low][1]]
                    low += 1
                if len(near) >= need and (not n or found[n - 1][0] != start):
                    tight, wide = (max(0, start - 1), min(len(words), start + size + 1)), (max(0, start - more), min(len(words), start + size + more))
                    out += [(t, *tight), (t, *wide)]
        return out


def densest(got: list[tuple[int, int]], size: int, least: float) -> list[tuple[int, int]]:
    """The densest run of aligned pairs that covers ``least`` of the template, so that a stray match beside a place doesn't spoil it."""
    best, most = [], (0.0, 0)
    for i in range(len(got)):
        for j in range(i + ceil(round(least * size, 6)), len(got) + 1):
            this = ((j - i) / max(size, got[j - 1][0] + 1 - got[i][0]), j - i)
            if this > most:
                best, most = got[i:j], this
    return best


def scan(text: str | None, templates: Templates, least: float = COVERAGE) -> list[tuple[str, float, int, int, str]]:
    """``(license, coverage, start_word, end_word, excerpt)`` of the licenses a text holds, one per place."""
    spans = [m.span() for m in TOKEN.finditer((text or ""))]
    words = [(text or "")[s:e].lower() for s, e in spans]
    best = []
    for t, lo, hi in templates.regions(words, least) if len(words) > 1 else ():
        name, wanted = templates.rows[t]
        got = densest(align(words[lo:hi], wanted), len(wanted), least)
        if not got:
            continue
        first, last = lo + got[0][0], lo + got[-1][0] + 1
        density = len(got) / max(len(wanted), last - first)
        if density >= least:
            best.append((len(got), density, -first, name, round(len(got) / len(wanted), 6), first, last))
    out: list[tuple[str, float, int, int, str]] = []
    for _, _, _, name, coverage, first, last in sorted(best, reverse=True):
        if all(last <= s or first >= e for _, _, s, e, _ in out):
            out.append((name, coverage, first, last, text[spans[first][0] : spans[last - 1][1]]))
    return sorted(out, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, start_word, end_word, excerpt``: each place of ``docs(doc_id, text)`` that a template covers.

    ``coverage`` is the share of the template's words that the alignment matches; at least ``least`` of them, and of the
    words from the first match to the last, must match. Words are compared without case and punctuation.
    Where templates overlap, the one that matches most words is reported, of those the densest. A template of one word is never found. Null and empty texts give no rows; rows that repeat are
    reported as often; a null id is kept. A notice repeated in a text is a place of its own each time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(templates)
        for pdf in batches:
            rows = [(d, *x) for d, t in zip(pdf.doc_id, pdf.text, strict=True) for x in scan(t, known, least)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start_word", "end_word", "excerpt"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, license string, coverage double, start_word long, end_word long, excerpt string"
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
