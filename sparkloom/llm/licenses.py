"""Licence scans: text units compared with licence templates by Dice over word bigrams.

Text is normalised to its runs of ASCII letters and digits in lower case. The units of a
document are its lines, its paragraphs (split at two line ends), the whole text, and passages. With A
and B the distinct word bigrams of a unit and a template, the unit matches if
2 |A and B| / (|A| + |B|) >= threshold. That bounds the sizes, t / (2 - t) <= |A| / |B| <= (2 - t) / t, so
only templates of like size are compared (of those that match, the best); and a document whose bigrams hold less
than t / (2 - t) of a template's can't have a unit that matches it, so most documents
are done after one pass over their words.

A passage is a run of words, wherever lines and paragraphs end, with at most (2 - t) / t times as
many word bigrams as a template has, repeats counted. All that match are found. Of those that share half of the longer
one only the best count (several if they tie), and none that so shares with a line, paragraph or text that matches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .licensetexts import TEXTS

WORD = re.compile("[A-Za-z0-9]+")
#: Hundredths.
THRESHOLD = 80

# Names and notices of public licences. ORACLE_SQL has these; the scan has TEXTS besides.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Templates:
    """Templates in order of size; templates without a bigram can't match and are left out."""

    def __init__(self, templates: list[tuple[str, str]], threshold: int):
        words = [(name, words_of(text)) for name, text in templates]
        sets = [(name, bigrams(w)) for name, w in words]
        self.longest = {(name, frozenset(bigrams(w))): (len(w) - 1) * (200 - threshold) // threshold for name, w in words}
        self.sets = sorted(((name, b) for name, b in sets if b), key=lambda x: (len(x[1]), x[0]))
        self.sizes, self.t = [len(b) for _, b in self.sets], threshold
        self.every = set().union(*[b for _, b in self.sets]) if self.sets else set()

    def may_match(self, found: set) -> bool:
        """Whether a document that holds these of the templates' bigrams can have a unit that matches."""
        return any(len(found & b) * (200 - self.t) >= self.t * len(b) for _, b in self.sets)

    def compare(self, unit: str):
        """(licence, Dice) of the best template that the unit matches, or of several if they tie."""
        own = bigrams(words_of(unit))
        n, t = len(own), self.t
        # |B| within n * t / (200 - t) and n * (200 - t) / t
        lo, hi = bisect_left(self.sizes, n * t / (200 - t)), bisect_right(self.sizes, n * (200 - t) / t)
        found = [(2 * both / (n + len(b)), name) for name, b in self.sets[lo:hi] if n and 200 * (both := len(own & b)) >= t * (n + len(b))]
        best = max(found, default=(0.0, ""))[0]
        return {(name, dice) for dice, name in found if dice == best}

    def passages(self, words: list[str], units: list[tuple[int, int]]) -> dict[str, float]:
        """For each licence in a passage: the best Dice. ``units`` are the words (from, to) of the units that match."""
        pairs, t = list(zip(words, words[1:], strict=False)), self.t
        last: dict[tuple[str, str], int] = {}
        before = np.empty(len(pairs), np.int64)  # the place of the same bigram before
        for i, pair in enumerate(pairs):
            before[i] = last.get(pair, -1)
            last[pair] = i
        found = []
        for k, (name, b) in enumerate(self.sets):
            if len(b & last.keys()) * (200 - t) < t * len(b):
                continue
            room = self.longest[name, frozenset(b)]
            inside = np.fromiter((pair in b for pair in pairs), bool, len(pairs))
            total = np.concatenate([[0], np.cumsum(inside)])
            starts = np.flatnonzero(inside)  # a passage that starts elsewhere has a better one within
            near = total[np.minimum(starts + room, len(pairs))] - total[starts]
            for i in starts[near * (200 - t) >= t * len(b)].tolist():
                new = before[i : i + room] < i
                n, both = np.cumsum(new), np.cumsum(new & inside[i : i + room])
                end = int(np.argmax(both / (n + len(b))))
                if 200 * both[end] >= t * (n[end] + len(b)):
                    found.append((2 * both[end] / (n[end] + len(b)), k, i, i + end + 1))
        best: dict[str, float] = {}
        if not found:
            return best
        dice, owner, first, end = (np.array(x) for x in zip(*found, strict=True))
        names = np.array([name for name, _ in self.sets])[owner]

        def like(a: int, b: int) -> np.ndarray:
            """Passages that share with bigrams a to b half of the longer."""
            return 2 * (np.minimum(end, b) - np.maximum(first, a)) >= np.maximum(end - first, b - a)

        alive = np.ones(len(dice), bool)
        for a, b in units:
            alive &= ~like(a, b - 1)
        for i in np.lexsort((first, -dice)).tolist():
            if alive[i]:
                best[str(names[i])] = max(best.get(str(names[i]), 0.0), float(dice[i]))
                alive &= ~(like(first[i], end[i]) & ((dice < dice[i]) | (names == names[i])))
        return best

    def scan(self, text: str | None) -> dict[str, tuple[int, float]]:
        """For each licence found: the number of lines that match and the best Dice of any unit."""
        text = text or ""
        words = words_of(text)
        if not self.may_match(self.every.intersection(zip(words, words[1:], strict=False))):
            return {}
        lines, best, units = defaultdict(int), defaultdict(float), []
        for kind, parts in (("line", text.split("\n")), ("paragraph", text.split("\n\n")), ("text", [text])):
            at = 0
            for unit in parts:
                end = at + len(words_of(unit))
                found = self.compare(unit)
                for name, dice in found:
                    best[name] = max(best[name], dice)
                    lines[name] += kind == "line"
                if found:
                    units.append((at, end))
                at = end
        for name, dice in self.passages(words, units).items():
            best[name] = max(best[name], dice)
        return {name: (lines[name], dice) for name, dice in best.items()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + TEXTS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, n_lines, dice) for each licence that a whole text holds; documents without one have no row.

    A licence that only paragraphs, the text or passages hold has n_lines 0. Null and empty texts hold none. Rows that repeat an id are scanned each.
    """

    def run(batches):
        found = Templates(templates, threshold)
        for batch in batches:
            rows = [(doc, name, n, dice) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for name, (n, dice) in sorted(found.scan(text).items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.float64()))], ["doc_id", "license_id", "n_lines", "dice"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, license_id string, n_lines long, dice double")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


_VALUES = ", ".join(f"('{name}', '{' '.join(words_of(text))}')" for name, text in TEMPLATES)
ORACLE_SQL = f"""
WITH template AS (
  SELECT license_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT license_id, string_split(words, ' ') AS w FROM (VALUES {_VALUES}) AS v(license_id, words))
), unit AS (
  SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'paragraph', unnest(string_split(text, chr(10) || chr(10))), generate_subscripts(string_split(text, chr(10) || chr(10)), 1) FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'text', text, 0 FROM documents WHERE text IS NOT NULL
), bag AS (
  SELECT doc_id, kind, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a
  FROM (SELECT doc_id, kind, k, list_transform(regexp_extract_all(u, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM unit)
  WHERE len(w) > 1
), hit AS (
  SELECT doc_id, license_id, kind, k, len(list_intersect(a, b)) AS shared, len(a) + len(b) AS n
  FROM bag JOIN template ON {200 - THRESHOLD} * len(a) >= {THRESHOLD} * len(b) AND {200 - THRESHOLD} * len(b) >= {THRESHOLD} * len(a)
), best AS (
  SELECT doc_id, license_id, kind, k, 2 * shared / n AS dice FROM hit WHERE 200 * shared >= {THRESHOLD} * n
  QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, kind, k)
)
SELECT doc_id, license_id, count(DISTINCT CASE WHEN kind = 'line' THEN k END) AS n_lines, max(dice) AS dice
FROM best GROUP BY doc_id, license_id
"""
