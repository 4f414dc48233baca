"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

A template's word 3-grams are winnowed (of every three in a row the one with the smallest hash stays) into an inverted
index from gram to template and place. All grams of a text are looked up there, so any run of five words that a text
shares with a template is found. Hits of a template on nearby diagonals make a candidate. One whose words, counted each
as often as the template has it, can't cover enough of the template is dropped; the others are aligned word by word
within a band around their diagonal, all of a template together. A band is no wider than a third of the template, so that
short notices that follow one another are found each.

Defined results: a null text, or one without words, has no row; a document gets a row for each span of each license,
repeated rows one each; of alignments of equal score the one with more matched words counts, then the one that starts
first, then the one that ends first; overlapping spans of different licenses are all reported; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from importlib.resources import files
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpweave.session import map_arrow

GRAM = 3
WINDOW = 3
#: Words by which an alignment may leave the diagonal of its hits, at most.
BAND = 8
COVERAGE = 0.8
#: Texts scanned together, and words of text aligned at once.
PIECE, CELLS = 256, 1 << 22

_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _WORD else 0x20 for b in range(256))

#: Fixed texts of short licenses, of notices and of parts that often stand alone.
SHORT = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0 notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense grant": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "MIT line 2": "Licensed under the MIT License.",
    "CC-BY line": "Licensed under CC BY 4.0.",
    "CC-BY-SA line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def templates() -> dict[str, str]:
    """The fixed texts, and the long licenses whole from the files of this package, by name."""
    return SHORT | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(files(__package__).joinpath("templates").iterdir(), key=lambda f: f.name)}


def words(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the smallest hash (the rightmost of equals) of every window; all windows of a shorter list are one."""
    kept: list[int] = []
    for i in range(max(len(hashes) - window, 0) + 1 if hashes else 0):
        part = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if not kept or kept[-1] != at:
            kept.append(at)
    return kept


class Index:
    """The inverted index of winnowed template fingerprints, over numbers of the templates' words."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        split = {n: words(t.encode()) for n, t in templates.items()}
        self.names = [n for n, s in split.items() if s]
        self.word = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for s in split.values() for w in s))}
        self.texts = [np.array([self.word[w] for w in split[n]], np.int32) for n in self.names]
        self.least = [-(-coverage * len(t) // 1) for t in self.texts]
        self.bands = [min(BAND, max(1, len(t) // 3)) for t in self.texts]
        self.base = len(self.word) + 1
        self.counts = [np.bincount(t, minlength=self.base) for t in self.texts]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, n in enumerate(self.names):
            s = split[n]
            hashes = [xxhash.xxh64_intdigest(b" ".join(s[i : i + GRAM])) for i in range(len(s) - GRAM + 1)]
            for i in winnow(hashes):
                self.places[self._code(self.texts[k][i : i + GRAM].tolist())].append((k, i))
        self.known = np.array(sorted(self.places), np.int64)

    def _code(self, ids: list[int]) -> int:
        code = 0
        for i in ids:
            code = code * self.base + i
        return code

    def numbers(self, data: bytes) -> np.ndarray:
        """The numbers of a text's words, zero for words of no template."""
        w = words(data)
        return np.fromiter(map(self.word.get, w, repeat(0)), np.int32, len(w))

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) for groups of hits of one template on diagonals less than a band apart."""
        if len(ids) < GRAM or not len(self.known):
            return []
        n, code = len(ids) - GRAM + 1, np.zeros(len(ids) - GRAM + 1, np.int64)
        for i in range(GRAM):
            code = code * self.base + ids[i : i + n]
        spot = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        hits: dict[int, list[int]] = defaultdict(list)
        for p in np.flatnonzero(self.known[spot] == code).tolist():
            for k, i in self.places[int(code[p])]:
                hits[k].append(p - i)
        out = []
        for k, diagonals in sorted(hits.items()):
            if len(ids) < self.least[k]:
                continue
            last = None
            for d in sorted(diagonals):
                if last is None or d - last > self.bands[k]:
                    out.append((k, d))
                    last = d
        return out

    def enough(self, k: int, ids: np.ndarray) -> bool:
        """Whether these words, each counted as often as the template has it, can cover enough of it."""
        return np.minimum(np.bincount(ids, minlength=self.base), self.counts[k])[1:].sum() >= self.least[k]


#: Parts of a cell: its score, matched words and, counted backwards, the first word; each has room below the one before.
_SCORE, _MATCH, _FIRST = 1 << 42, 1 << 21, (1 << 21) - 1


def align(template: np.ndarray, text: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched words, first word, word after the last) of the best local alignment of a template with each row of ``text``.

    A row has the words from a band before the template's first place to a band after its last, -1 where there are none.
    A matched word counts two, a replaced, missing or added one counts minus one."""
    width, many = 2 * band + 1, len(text)
    steps = np.arange(width, dtype=np.int64) * _SCORE
    before = np.zeros((many, width + 1), np.int64)
    best, end = np.zeros(many, np.int64), np.zeros(many, np.int64)
    for i, word in enumerate(template.tolist()):
        diagonal, same = before[:, :width], text[:, i : i + width] == word
        begun = np.where(diagonal == 0, _FIRST - (i + np.arange(width)), 0)
        cell = np.where(same, diagonal + begun + 2 * _SCORE + _MATCH, diagonal - _SCORE)
        np.maximum(cell, before[:, 1:] - _SCORE, out=cell)
        cell[cell < _SCORE] = 0
        # a run of added words: the best cell to the left, less one for each step
        np.maximum(cell, np.maximum.accumulate(cell + steps, axis=1) - steps, out=cell)
        cell[cell < _SCORE] = 0
        before[:, :width] = cell
        at = cell.argmax(axis=1)
        top = cell[np.arange(many), at]
        more = top > best
        best[more], end[more] = top[more], i + at[more] + 1
    return (best % _SCORE) // _MATCH, _FIRST - best % _MATCH, end


def scan(texts: list[bytes], index: Index) -> list[list[tuple[str, int, float, int, int]]]:
    """For each text (license, matched words, coverage, first byte, byte after the last) of all spans that cover enough of a template."""
    numbers = [index.numbers(data) for data in texts]
    todo: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for row, ids in enumerate(numbers):
        for k, diagonal in index.candidates(ids):
            b = index.bands[k]
            if index.enough(k, ids[max(0, diagonal - b) : max(0, diagonal + len(index.texts[k]) + b)]):
                todo[k].append((row, diagonal - b))
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for k, places in sorted(todo.items()):
        size = len(index.texts[k]) + 2 * index.bands[k]
        for at in range(0, len(places), step := max(1, CELLS // size)):
            some = places[at : at + step]
            text = np.full((len(some), size), -1, np.int32)
            for out, (row, begin) in zip(text, some):
                part = numbers[row][max(0, begin) : max(0, begin + size)]
                out[max(0, -begin) : max(0, -begin) + len(part)] = part
            for (row, begin), matched, first, last in zip(some, *(x.tolist() for x in align(index.texts[k], text, index.bands[k]))):
                if matched >= index.least[k]:
                    found[row].append((k, matched, first + begin, last + begin))
    return [_spans(data, found[row], index) if row in found else [] for row, data in enumerate(texts)]


def _spans(data: bytes, found: list[tuple[int, int, int, int]], index: Index) -> list[tuple[str, int, float, int, int]]:
    """Of spans of one license that overlap the one with more matched words stays, then the first."""
    kept: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, matched, a, b in sorted(found, key=lambda x: (x[0], x[2], -x[1])):
        if not kept[k] or a >= kept[k][-1][2]:
            kept[k].append((matched, a, b))
        elif matched > kept[k][-1][0]:
            kept[k][-1] = (matched, a, b)
    flat, at, starts = data.translate(_TABLE), 0, []
    for w in flat.split():
        at = flat.index(w, at)
        starts.append((at, at := at + len(w)))
    return [(index.names[k], m, m / len(index.texts[k]), starts[a][0], starts[b - 1][1]) for k, spans in sorted(kept.items()) for m, a, b in spans]


def scanned(docs: DataFrame, chosen: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, license, matched, coverage, start, end): spans in characters of the text from zero, the end not included.

    The index is as large as the templates, which are a parameter, and travels with the tasks."""
    chosen = templates() if chosen is None else chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        index = Index(chosen, coverage)
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
                row, out = [], []
                for i, (data, spans) in enumerate(zip(texts, scan(texts, index))):
                    for name, matched, share, a, b in spans:
                        row.append(i)
                        start = len(data[:a].decode("utf-8", "ignore"))
                        out.append((name, matched, share, start, start + len(data[a:b].decode("utf-8", "ignore"))))
                name, matched, share, a, b = zip(*out) if out else ((),) * 5
                yield [batch.column(0).take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(matched, pa.int32()), pa.array(share, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]

    fields = [("license", "string"), ("matched", "int"), ("coverage", "double"), ("start", "long"), ("end", "long")]
    return map_arrow(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), run, [id_col], fields)
