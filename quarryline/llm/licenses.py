"""License scans by conditional compression.

The words around a text's cues, as far as the longest template and its slack reach, form blocks. Each block is compressed by zstandard
alone and with each template as a raw dictionary, and templates are ranked by the share of its size that they save. Words are compressed
lower-cased and with one space between, so that wraps and marks play no part. From the best down a template is confirmed by its exact
wording: each cue is laid on each like cue of the template and the words around, as many as the template has and its slack, are aligned
with it at least cost: words missing or added within the span count one each, up to `tolerance` of the template's words; a number or a
deciding word may neither miss nor be added. A cue within a notice that stands word for word is settled for the templates further down;
the rank ends nowhere else, so a notice of few words in a long block is found as well. A template is laid only where the words at hand
can reach its tolerance.
Where confirmed notices overlap, each span is compressed alone and with its template: the most bytes saved, less some for each word that
differs, as licenses that hold each other's clauses save alike, stays.

Blocks: confirmed notices; the cues outside them lie in blocks without a license: the lines of a run of such cues (cut at `block_words`
words), of a line over `line_words` words each sentence. Nothing is left out: every cue lies in a block.

Defined results: a null or empty text has no blocks; repeated rows are scanned alike; an empty table gives an empty result; texts of
any length are scanned whole. Only the named columns are read, so further columns can't clash. Positions are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarryline.llm import _text

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_SOURCE, _BINARY = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
#: License and a wording of its notice, or its whole text. Names, notices and texts of public licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSD-2-Clause", f"{_BSD} {_SOURCE} {_BINARY} {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD} 1. {_SOURCE} 2. {_BINARY} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_SOURCE} {_BINARY} {_NAMES} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 1. {_SOURCE} 2. {_BINARY} 3. {_NAMES} {_AS_IS}"),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
]
#: Words that decide between licenses: one that differs refuses a template.
DECIDING = {"mit", "apache", "gnu", "lesser", "affero", "bsd", "mozilla", "cc", "cc0", "by", "nc", "sa", "nd", "noncommercial", "commons", "attribution", "sharealike", "not", "proprietary"}
CUE = re.compile(r"licen[cs]|copyright|redistribut|public domain|creative commons|\bcc[ -]?(?:by|0)\b|permission is hereby|all rights reserved|spdx|free software|warrant", re.I)
#: The same with any marks and line breaks between words.
_WRAPPED = re.compile(r"licen[cs]|copyright|redistribut|public[\W_]+domain|creative[\W_]+commons|\bcc[\W_]*(?:by|0)\b|permission[\W_]+is[\W_]+hereby|all[\W_]+rights[\W_]+reserved|spdx|free[\W_]+software|warrant", re.I)
_QUICK = ("licen", "copyright", "redistribut", "domain", "creative", "cc", "hereby", "reserved", "spdx", "software", "warrant")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
_WORD_BYTES, _LONGEST, _RUN_WORDS = 2, 64, 1000
_SENTENCE = re.compile(r"[^.!?]+(?:[.!?](?!\s|$)[^.!?]*)*[.!?]*")


def blocks(text: str, taken: list[tuple[int, int]] = (), line_words: int = 120, block_words: int = 240) -> Iterator[tuple[int, int]]:
    """(start, end) of blocks around the cues outside the taken spans, which are in order and apart."""
    starts = [s for s, _ in taken]

    def parts(start: int, end: int) -> Iterator[tuple[int, int]]:
        """What the taken spans leave of a range."""
        for s, e in taken[max(bisect_right(starts, start) - 1, 0) : bisect_left(starts, end)]:
            if s > start:
                yield start, s
            start = max(start, e)
        if start < end:
            yield start, end

    run: list[tuple[int, int]] = []
    count, at = 0, 0
    for line in text.split("\n"):
        own = [p for p in parts(at, at + len(line)) if CUE.search(text, *p)] if CUE.search(line) else []
        for s, e in own:
            n = len(text[s:e].split())
            whole = e - s == len(line)
            if run and (not whole or n > line_words or count + n > block_words):
                yield run[0][0], run[-1][1]
                run, count = [], 0
            if n > line_words:
                for m in _SENTENCE.finditer(text, s, e):
                    if CUE.search(m[0]):
                        yield m.span()
            elif whole:
                run.append((s, e))
                count += n
            else:
                yield s, e
        if run and not own:
            yield run[0][0], run[-1][1]
            run, count = [], 0
        at += len(line) + 1
    if run:
        yield run[0][0], run[-1][1]


def _cues(text: str) -> list[tuple[int, str]]:
    """(position, words) of every cue, wrapped ones too."""
    return [(m.start(), " ".join(_WORD.findall(m[0].lower()))) for m in _WRAPPED.finditer(text)]


@lru_cache(maxsize=2)
def _prepared(templates: tuple[tuple[str, str], ...]):
    """Compressors without and with each template, each template's compressed size, its words, their counts, and by each cue's wording the
    words at which each template has it."""
    import zstandard as z

    plain = z.ZstdCompressor(level=3, write_content_size=False)
    words, places = [], {}
    for i, (_, t) in enumerate(templates):
        found = list(_WORD.finditer(t))
        words.append([m[0].lower() for m in found])
        ends = [m.end() for m in found]
        for at, cue in _cues(t):
            places.setdefault(cue, {}).setdefault(i, []).append(bisect_right(ends, at))
    raw = [_raw(w) for w in words]
    own = [z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(r, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False) for r in raw]
    return plain, own, [len(plain.compress(r)) for r in raw], words, [Counter(w) for w in words], places


def _raw(words: list[str]) -> bytes:
    """Words as they are compressed; of a long one its start, so that a block stays within the reach of a dictionary."""
    return " ".join(w[:_LONGEST] for w in words).encode()


def savings(block: list[str], templates: tuple[tuple[str, str], ...]) -> list[tuple[float, int]]:
    """(share of the block's size saved, template number) of every template, the best first; ties by number."""
    plain, own = _prepared(templates)[:2]
    raw = _raw(block)
    alone = len(plain.compress(raw))
    return sorted(((1 - len(c.compress(raw)) / alone, i) for i, c in enumerate(own)), key=lambda x: (-x[0], x[1]))


def _runs(at: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Ranges of cues, given by their words, that share a block: apart by `reach` at most and, first to last, by `_RUN_WORDS`."""
    first = 0
    for j in range(1, len(at) + 1):
        if j == len(at) or at[j] - at[j - 1] > reach or at[j] - at[first] > _RUN_WORDS:
            yield first, j
            first = j


def _fixed(word: str) -> bool:
    return word in DECIDING or word[0].isdigit()


def wording(block: list[str], template: list[str], most: int) -> tuple[int, int, int, int] | None:
    """(first word, word after the last, template words missing, words added between) of the cheapest alignment of the template with a
    run of the block, None above `most`. A number or a deciding word neither misses nor is added."""
    never = most + 1
    above = [(0, 0, j) for j in range(len(block) + 1)]  # cost, missing, first word
    added = [never if _fixed(w) else 1 for w in block]
    for t in template:
        lost = never if _fixed(t) else 1
        row = [(above[0][0] + lost, above[0][1] + 1, 0)]
        for j, w in enumerate(block):
            if w == t:
                row.append(above[j])
                continue
            up, left = above[j + 1], row[j]
            row.append((up[0] + lost, up[1] + 1, up[2]) if up[0] + lost <= left[0] + added[j] else (left[0] + added[j], left[1], left[2]))
        above = row
    cost, end = min((x[0], j) for j, x in enumerate(above))
    return (above[end][2], end, above[end][1], cost - above[end][1]) if cost <= most else None


def _quick(low: str) -> bool:
    return any(q in low for q in _QUICK)


def notices(text: str, templates: tuple[tuple[str, str], ...], tolerance: float) -> list[tuple[int, int, str, float, int, int]]:
    """Confirmed notices in order, none overlapping: start, end, license, bytes saved by the template's own size, words missing and added."""
    plain, own, sizes, words, bags, places = _prepared(templates)
    cues = [(at, cue) for at, cue in _cues(text) if cue in places]
    if not cues:
        return []
    found = list(_WORD.finditer(text))
    low, ends = [m[0].lower() for m in found], [m.end() for m in found]
    at = [bisect_right(ends, x) for x, _ in cues]
    reach = max(map(len, words))
    reach += int(tolerance * reach)
    spans: dict[tuple[int, int, int], tuple[int, int]] = {}
    for first, last in _runs(at, reach):
        left = range(first, last)
        for _, i in savings(low[max(at[first] - reach, 0) : at[last - 1] + reach], templates):
            n = len(words[i])
            most = int(tolerance * n)
            settled = set()
            for j in left:
                for k in places[cues[j][1]].get(i, ()):
                    a = at[j] - k
                    if a >= 0 and low[a : a + n] == words[i]:
                        spans[i, a, a + n] = (0, 0)
                        settled.update(range(a, a + n))
                    elif most:
                        a = max(a - most, 0)
                        near = low[a : at[j] - k + n + most]
                        if sum((bags[i] & Counter(near)).values()) >= n - most and (x := wording(near, words[i], most)):
                            spans[i, a + x[0], a + x[1]] = x[2:]
            left = [j for j in left if at[j] not in settled]
    ranked = []
    for _, i, a, b, missing, added in _apart([(x + y, i, a, b, x, y) for (i, a, b), (x, y) in spans.items()], lambda x: (x[1], *x[2:4])):
        start, end = found[a].start(), ends[b - 1]
        end += text[end : end + 1] in {".", ":"}  # the mark that ends the notice
        raw = _raw(low[a:b])
        saved = len(plain.compress(raw)) - len(own[i].compress(raw))
        ranked.append((_WORD_BYTES * (missing + added) - saved, missing + added, i, start, end, missing, added, saved))
    return sorted((start, end, templates[i][0], saved / sizes[i], missing, added) for _, _, i, start, end, missing, added, saved in _apart(ranked, lambda x: (0, *x[3:5])))


def _apart(ranked: list[tuple], place) -> list[tuple]:
    """Those, the first in rank before others, that overlap none taken of the same kind; place gives kind, start and end."""
    out, taken = [], {}
    for x in sorted(ranked):
        kind, start, end = place(x)
        own = taken.setdefault(kind, [])
        at = bisect_left(own, (start, end))
        if (at == len(own) or own[at][0] >= end) and (not at or own[at - 1][1] <= start):
            own.insert(at, (start, end))
            out.append(x)
    return out


def licensed(text: str | None, templates: tuple[tuple[str, str], ...], tolerance: float = 0.15) -> list[tuple[int, int, str | None, float, int, int]]:
    """For each block: start, end, license (null: none confirmed), bytes saved by the template's own size, words missing and added."""
    if not text or not _quick(text.lower()):
        return []
    sure = notices(text, templates, tolerance)
    return sorted([*sure, *((s, e, None, 0.0, 0, 0) for s, e in blocks(text, [x[:2] for x in sure]))], key=lambda x: x[:2])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id and blocks, an array of (start, end, license, saved, missing, added)."""
    fixed = tuple(map(tuple, templates))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("saved", pa.float64()), ("missing", pa.int64()), ("added", pa.int64())]))
    names = ["start", "end", "license", "saved", "missing", "added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text", 1 << 20):
            found = [[dict(zip(names, x, strict=True)) for x in licensed(t, fixed)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], [id_col, "blocks"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, blocks array<struct<start:bigint,end:bigint,license:string,saved:double,missing:bigint,added:bigint>>")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sure = F.filter("blocks", lambda b: b["license"].isNotNull())
    return found.select(
        "doc_id", F.size("blocks").cast("long").alias("n_blocks"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda b: b["license"]))), ",").alias("licenses"),
        F.array_join(F.transform(sure, lambda b: F.concat_ws(":", b["license"], b["start"], b["end"], b["missing"], b["added"])), ",").alias("spans"),
    )
