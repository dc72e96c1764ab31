"""Licence notices in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import emptied, slices
from .common import bounded_batches, table
from .shingles import mix, span_hashes

#: Wordings of common licence notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT line": "Released under the MIT License.",
    "MIT notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-2-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause third condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-3.0 or later notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0 notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
GRAM, WINDOW = 3, 2  # any 4 equal words in a row hold a fingerprint
SHORT, SHORT_GRAM = 12, 2  # words of a template that is short; all its grams of 2 words are listed
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of runs of ASCII letters, digits and other characters; their first bytes; last bytes; the words before each text's end)."""
    begins, stops = LETTER[data], LETTER[data]
    solid = begins.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    cuts = ends[1:-1][(ends[1:-1] < len(data)) & (ends[1:-1] > 0)]
    begins[cuts], stops[cuts - 1] = solid[cuts], solid[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    return span_hashes(data, first, last), first, last, np.searchsorted(first, ends)


def grams_of(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    n = max(len(words) - size + 1, 0)
    found = np.full(n, size, np.uint64)
    for k in range(size if n else 0):
        found = mix(found ^ words[k : k + n])
    return found


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: in each ``window`` grams in a row the first least one (Schleimer et al., 2003)."""
    if len(grams) <= window:
        return np.array([int(grams.argmin())]) if len(grams) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(windows)) + windows.argmin(axis=1))


class Index:
    """The templates' words, and an inverted index: fingerprints, sorted, with template and place.

    Fingerprints are those of the winnowed template; a document's grams are all looked up, so
    any copy of a template's ``GRAM + WINDOW - 1`` words in a row is found, whatever stands
    around it. A template of ``SHORT`` words or fewer, of which a few changed words leave no
    such row, has all its grams of ``SHORT_GRAM`` words as fingerprints.
    """

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        self.words, prints, of, at = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            words = letter_words(data, np.array([0, len(data)]))[0]
            self.words.append(words)
            short = len(words) <= SHORT
            grams = grams_of(words, SHORT_GRAM if short else GRAM)
            places = winnow(grams, 1 if short else WINDOW)
            prints.append(grams[places])
            of.append(np.full(len(places), k))
            at.append(places)
        order = np.argsort(np.concatenate(prints), kind="stable")
        self.prints, self.of, self.at = np.concatenate(prints)[order], np.concatenate(of)[order], np.concatenate(at)[order]
        self.sizes = sorted({SHORT_GRAM if len(w) <= SHORT else GRAM for w in self.words})

    def seen(self, words: np.ndarray) -> np.ndarray:
        """Places of the words where a fingerprint begins."""
        places = [np.flatnonzero(np.isin(grams_of(words, size), self.prints)) for size in self.sizes]
        return np.unique(np.concatenate([np.zeros(0, np.int64), *places]))

    def hits(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) of each fingerprint found, each once, sorted."""
        out = [np.zeros(0, np.int64)]
        for size in self.sizes:
            grams = grams_of(words, size)
            lo, hi = np.searchsorted(self.prints, grams), np.searchsorted(self.prints, grams, side="right")
            many = hi - lo
            place = np.repeat(np.arange(len(grams)), many)
            j = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            out.append(np.unique((self.of[j] << 40) + place - self.at[j] + (1 << 39)))
        both = np.unique(np.concatenate(out))
        return list(zip((both >> 40).tolist(), ((both & ((1 << 40) - 1)) - (1 << 39)).tolist(), strict=True))


def most_matches(template: np.ndarray, words: np.ndarray, diagonals: np.ndarray, band: int) -> np.ndarray:
    """How many of the template's words occur within the band of each diagonal: no alignment there has more matches."""
    out = np.zeros(len(diagonals), np.int64)
    step = max(1, (1 << 20) // len(template))
    for at in range(0, len(diagonals), step):
        first = diagonals[at : at + step, None] + np.arange(len(template))
        met = np.zeros(first.shape, bool)
        for k in range(-band, band + 1):
            place = first + k
            inside = (place >= 0) & (place < len(words))
            met |= inside & (words[np.where(inside, place, 0)] == template)
        out[at : at + step] = met.sum(axis=1)
    return out


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Pairs (template word, document word) of the best alignment near ``diagonal``, ends of the document free.

    A match is worth 2, a mismatch or a gap costs 1; template word i meets document words from
    i + diagonal - band to i + diagonal + band.
    """
    rows, width = len(template), 2 * band + 1
    score = np.zeros((rows + 1, width), np.int32)
    step = np.zeros((rows + 1, width), np.int8)
    for i in range(1, rows + 1):
        base = i - 1 + diagonal - band
        for k in range(width):
            j = base + k
            same = 0 <= j < len(words) and template[i - 1] == words[j]
            best, way = score[i - 1, k] + (2 if same else -1), 1 if same else 2
            if k + 1 < width and score[i - 1, k + 1] - 1 > best:
                best, way = score[i - 1, k + 1] - 1, 3
            if k and score[i, k - 1] - 1 > best:
                best, way = score[i, k - 1] - 1, 4
            score[i, k], step[i, k] = best, way
    k, i, pairs = int(score[rows].argmax()), rows, []
    while i:
        way = step[i, k]
        if way == 1:
            pairs.append((i - 1, i - 1 + diagonal - band + k))
        if way in (1, 2):
            i -= 1
        elif way == 3:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return pairs[::-1]


def find(index: Index, words: np.ndarray, band: int, least: float) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched words, first and last document word) of each notice in a document."""
    chosen: dict[int, list[int]] = {}
    for template, diagonal in index.hits(words):
        own = chosen.setdefault(template, [])
        if not own or diagonal - own[-1] > band:  # else the alignment on the last one covers this diagonal
            own.append(diagonal)
    out = []
    for template, own in chosen.items():
        text = index.words[template]
        places = np.array(own)
        for diagonal in places[most_matches(text, words, places, band) >= least * len(text)].tolist():
            pairs = align(text, words, diagonal, band)
            if pairs and len(pairs) >= least * len(text):
                found = (template, len(pairs) / len(text), len(pairs), pairs[0][1], pairs[-1][1])
                if not out or out[-1][0] != template or found[3] > out[-1][4]:
                    out.append(found)
                elif found[2] > out[-1][2]:
                    out[-1] = found
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8, band: int = 4) -> DataFrame:
    """A row per notice found: ``id_col``, license, coverage, n_matched, start, stop (bytes of the text's UTF-8).

    Words are runs of letters and digits, lower-cased in ASCII. All grams of whole
    documents are looked up in the index of the templates' fingerprints; each diagonal that a hit
    lies on is aligned within ``band`` words to either side, and reported if at least
    ``least`` of the template's words match. Notices of one template that overlap give the
    better one. Row-local: nothing is shuffled and the index, of the templates alone, is
    small. Null, empty and other texts without a notice give no rows; null and repeated ids
    and repeated rows are reported as they are; other columns are not read. A long text costs
    some 40 bytes of memory a byte while it is looked at.
    """
    index = Index(TEMPLATES if templates is None else templates)
    source = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in slices(batches, "text", 4 << 20):
            words, first, last, at = letter_words(data, ends)
            near = index.seen(words)
            found: Sequence = []
            for i in np.unique(np.searchsorted(at, near, side="right") - 1).tolist():
                own = words[at[i] : at[i + 1]]
                found += [(i, index.names[t], cover, m, int(first[at[i] + a] - ends[i]), int(last[at[i] + b] + 1 - ends[i])) for t, cover, m, a, b in find(index, own, band, least)]
            if found:
                row, *values = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), *map(pa.array, values)], names=[id_col, "license", "coverage", "n_matched", "start", "stop"])

    return source.mapInArrow(lambda it: emptied(run(it)), f"`{id_col}` {source.schema['id'].dataType.simpleString()}, license string, coverage double, n_matched bigint, start bigint, stop bigint")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices in all documents."""
    return scan(table(spark, sf_dir, "documents"))
