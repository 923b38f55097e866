"""License scans by conditional compression.

Candidate blocks are the words around each cue of licensing, as many on both sides as the longest template's place may
have, whatever the lines; blocks that meet are one. A block is compressed by itself and with each template as zstandard
raw dictionary: the bytes that a template saves rank the templates, and the first of them is given as the nearest. Down
the ranking, the exact differences (words to insert, delete or replace) confirm every place with a word similarity of
0.8 or more, and the differing words are given. A template that saves nothing is last, but is tried (bar those of which
too many words are absent, each an edit), so the ranking loses no place. Each confirmed place is compressed again, by
itself and with its template: where templates are confirmed on the same words, that which saves most bytes of its place
is given, of equals the earlier in the ranking. A block without a place is a row too, with the most bytes that any
template saves.

Cases: a null or empty text has no block; templates that save equally many bytes rank by name; documents that share a doc_id are
scanned each; an empty table gives no row; whole texts are read, of any length; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import small_batches

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_MIT_REST = ', including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Notices of public licenses.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": _BSD_GRANT,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": _MIT_GRANT,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Whole texts of public licenses that are short.
TEXTS = {
    "BSD-2-Clause-text": _BSD_GRANT + _BSD_TWO + _BSD_WARRANTY,
    "BSD-3-Clause-text": _BSD_GRANT + _BSD_TWO + _BSD_THIRD + _BSD_WARRANTY,
    "ISC-text": f"{_ISC_GRANT} {_ISC_WARRANTY}",
    "MIT-text": _MIT_GRANT + _MIT_REST,
}
CUE = re.compile(r"licen[sc]e|copyright|warrant|redistribut|permission\W+is\W+hereby|all\W+rights\W+reserved", re.IGNORECASE)
TOKEN = re.compile(r"\w+(?:[.-]\w+)*")
SIMILAR = 0.8


def allowed(size: int) -> int:
    """The most word edits that a template of so many words may be from a place."""
    return int((1 - SIMILAR) * size + 1e-9)


def reach(templates: dict[str, str] = TEMPLATES) -> int:
    """The words that the longest place of any template has: those of the template and the edits it may insert."""
    return max((n + allowed(n) for n in (len(words(t)) for t in templates.values())), default=0)


def blocks(text: str | None, span: int | None = None) -> Iterator[tuple[int, str]]:
    """(offset in characters, block) of each candidate: `span` words on both sides of every cue, whatever the lines."""
    if not text:
        return
    cues = [m.span() for m in CUE.finditer(text)]
    if not cues:
        return
    span = reach() if span is None else span
    places = [m.span() for m in TOKEN.finditer(text)]
    starts, ends = [a for a, _ in places], [b for _, b in places]
    low = high = None
    for a, b in cues:
        first, last = bisect_right(ends, a) - span, bisect_left(starts, b) - 1 + span
        if low is not None and first <= high + 1:
            high = max(high, last)
            continue
        if low is not None:
            yield starts[max(0, low)], text[starts[max(0, low)] : ends[min(high, len(ends) - 1)]]
        low, high = first, last
    yield starts[max(0, low)], text[starts[max(0, low)] : ends[min(high, len(ends) - 1)]]


def ends_of(template: list[str], block: list[str], most: int) -> list[tuple[int, int]]:
    """(edits, end) of every end of a run of words of the block that is at most `most` word edits from the template.

    A column of the table of edits is two integers of a bit a word (Myers).
    """
    size = len(template)
    masks: dict[str, int] = {}
    for i, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, edits, out = full, 0, size, []
    for end, w in enumerate(block, 1):
        eq = masks.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            edits += 1
        elif down & top:
            edits -= 1
        up, down = up << 1 & full, down << 1 & full  # the run may begin anywhere
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if edits <= most:
            out.append((edits, end))
    return out


def start_of(template: list[str], block: list[str], end: int, edits: int) -> int:
    """The latest start of a run that ends there and is so many edits from the template."""
    row = list(range(len(template) + 1))
    back = template[::-1]
    for n, w in enumerate(reversed(block[max(0, end - len(template) - edits) : end]), 1):
        last, row[0] = row[0], n
        for i, t in enumerate(back, 1):
            last, row[i] = row[i], min(last + (t != w), row[i] + 1, row[i - 1] + 1)
        if row[-1] == edits:
            return end - n
    return end


def changes(template: list[str], place: list[str]) -> list[str]:
    """The fewest word edits that turn the template into the place, in order: -word, +word, or -word+word."""
    rows = [list(range(len(place) + 1))]
    for i, t in enumerate(template, 1):
        above, row = rows[-1], [i]
        for j, w in enumerate(place, 1):
            row.append(min(above[j - 1] + (t != w), above[j] + 1, row[-1] + 1))
        rows.append(row)
    i, j, out = len(template), len(place), []
    while i or j:
        here = rows[i][j]
        if i and j and here == rows[i - 1][j - 1] + (template[i - 1] != place[j - 1]):
            i, j = i - 1, j - 1
            if template[i] != place[j]:
                out.append(f"-{template[i]}+{place[j]}")
        elif i and here == rows[i - 1][j] + 1:
            i -= 1
            out.append(f"-{template[i]}")
        else:
            j -= 1
            out.append(f"+{place[j]}")
    return out[::-1]


def differences(template: list[str], block: list[str]) -> int:
    """Fewest word edits that turn the template into some run of words of the block."""
    return min((e for e, _ in ends_of(template, block, len(template))), default=len(template))


def words(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = 3):
        import zstandard

        self.words = {n: words(templates[n]) for n in sorted(templates)}
        self.span = reach(templates)
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.given = {n: zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, w in self.words.items()}
        self.known: dict[str, list[tuple]] = {}

    def ranking(self, raw: bytes) -> tuple[int, list[tuple[int, str]]]:
        """Bytes of the block compressed by itself, and (minus the bytes saved, template) of all templates, most saved first."""
        alone = len(self.plain.compress(raw))
        return alone, sorted((len(c.compress(raw)) - alone, n) for n, c in self.given.items())

    def places(self, own: list[str], order: list[str]) -> list[tuple]:
        """(first word, end, template, edits, bytes by itself, bytes saved) of every confirmed place, in the block's order."""
        there, found = set(own), []
        for rank, n in enumerate(order):
            template = self.words[n]
            most = allowed(len(template))
            if not template or sum(w not in there for w in template) > most:
                continue  # each absent word is an edit
            taken: list[int] = []
            for edits, end in sorted(ends_of(template, own, most)):
                if all(abs(end - t) > len(template) // 2 for t in taken):
                    taken.append(end)
                    first = start_of(template, own, end, edits)
                    raw = " ".join(own[first:end]).encode()
                    alone = len(self.plain.compress(raw))
                    found.append((len(self.given[n].compress(raw)) - alone, rank, edits, first, end, n, alone))
        kept: list[tuple] = []
        for more, _, edits, first, end, n, alone in sorted(found):  # of templates on the same words, that which saves most
            if all(2 * (min(end, e) - max(first, f)) < min(end - first, e - f) for f, e, *_ in kept):
                kept.append((first, end, n, edits, alone, -more))
        return sorted(kept)

    def judge(self, block: str) -> list[tuple]:
        """(first word, end, license, bytes by itself, bytes saved, share of the template's words found, number of differing
        words, those words, the block's nearest template) of every confirmed place, or one row of the whole block with no
        license. Nearest is the first of the ranking, null if it saves nothing.
        """
        own = words(block)
        key = " ".join(own)
        if key not in self.known:
            alone, ranked = self.ranking(key.encode())
            most = max(0, -ranked[0][0]) if ranked else 0
            nearest = ranked[0][1] if most else None
            rows = []
            for first, end, n, edits, small, less in self.places(own, [n for _, n in ranked]):
                rows.append((first, end, n, small, less, 1 - edits / len(self.words[n]), edits, changes(self.words[n], own[first:end]) if edits else [], nearest))
            if not rows:
                rows = [(0, len(own), None, alone, most, 0.0, None, None, nearest)]
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[key] = rows
        return self.known[key]

    def rows(self, text: str | None) -> Iterator[tuple]:
        """(offset, characters, what judge() says, the text there) of every confirmed place, or block without one."""
        for at, block in blocks(text, self.span):
            spans = [m.span() for m in TOKEN.finditer(block)]
            for first, end, *said in self.judge(block):
                a, b = spans[first][0], spans[end - 1][1]
                yield at + a, b - a, *said, block[a:b]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row per confirmed place of whole texts, and one with no license per candidate block without such a place."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(templates)
        names = ["doc_id", "block_start", "block_chars", "license", "alone_bytes", "saved_bytes", "similarity", "n_differences", "changes", "nearest", "block"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string())
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in scanner.rows(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, block_start long, block_chars long, license string, alone_bytes long, saved_bytes long, similarity double, n_differences long, changes array<string>, nearest string, block string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(small_batches).mapInArrow(run, schema)
