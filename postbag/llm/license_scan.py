"""Licence notices found by conditional compression and confirmed word by word.

Around neighbouring words of a template the text has a candidate block about as long as the template, over
line ends and blank lines. Each block is compressed with every template that has two neighbouring words in
it as a raw dictionary; templates are ranked by the bytes they save, and the best one above the threshold
that has the block's wording wins. The differences in wording are part of the result.
"""

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate
from math import ceil

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import per_worker, plain

# The usual notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

# Words of licences' names, which like versions must be equal, and words that deny what follows.
NAMES = frozenset("affero apache boost by cc cc0 eclipse general gnu isc lesser library mit mozilla mpl nc nd public sa".split())
NEGATIONS = frozenset("aren cannot isn longer neither never nor not wasn weren".split())

WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def in_order(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest row of hits whose places rise both in the text and in the template."""
    ends, last, before = [], [], {}
    for i, k in sorted(hits, key=lambda h: (h[0], -h[1])):
        j = bisect_left(ends, k)
        ends[j : j + 1], last[j : j + 1] = [k], [(i, k)]
        before[i, k] = last[j - 1] if j else None
    row, at = [], last[-1] if last else None
    while at:
        row.append(at)
        at = before[at]
    return row[::-1]


class Scanner:
    """Finds the notices of ``templates`` in texts."""

    def __init__(self, templates: dict[str, str], least_reduction: float, least_cover: float, names=NAMES):
        self.least_reduction, self.least_cover, self.names = least_reduction, least_cover, names
        self.wanted = {name: words_of(t) for name, t in templates.items()}
        # a raw dictionary is content that may be copied from, without tables or an id
        self.with_template = {
            name: self._compressor(zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, w in self.wanted.items()
        }
        self.without = self._compressor(None)
        self.empty = len(self.without.compress(b""))
        self.slack, self.least_pairs = {}, {}
        pairs = defaultdict(list)
        for name, words in self.wanted.items():
            n = len(words)
            self.slack[name] = slack = n // 2 + 3
            # a missing word takes two pairs of neighbours away, one put in between takes one
            self.least_pairs[name] = max(1, n - 1 - 2 * (n - ceil(least_cover * n)) - slack)
            for k in range(n - 1):
                pairs[f" {words[k]} {words[k + 1]} "].append((name, k))
        anchors = ahocorasick.Automaton()
        for pair, places in pairs.items():
            anchors.add_word(pair, places)
        anchors.make_automaton()
        self.anchors = anchors

    @staticmethod
    def _compressor(dictionary):
        return zstandard.ZstdCompressor(
            level=9, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def anchored(self, words: list[str]) -> dict[str, list[tuple[int, int]]]:
        """For each template where two of its neighbouring words stand: place in the text, in the template."""
        hits = list(self.anchors.iter(f" {' '.join(words)} "))
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        if hits:
            ends = list(accumulate(len(w) + 1 for w in words))  # of each word, the place of the space after it
            for end, places in hits:
                i = bisect_left(ends, end) - 1
                for name, k in places:
                    found[name].append((i, k))
        return found

    def ranked(self, text: str, names: list[str]) -> list[tuple[int, float, str]]:
        """The templates by the bytes that each saves as dictionary of ``text``: bytes, share of the size, name."""
        data = text.encode("utf-8", "replace")
        alone = max(1, len(self.without.compress(data)) - self.empty)
        saved = [(alone - max(0, len(self.with_template[x].compress(data)) - self.empty), x) for x in names]
        return [(n, n / alone, x) for n, x in sorted(saved, key=lambda s: (-s[0], s[1]))]

    def worded(self, name: str, words: list[str], first: int, end: int) -> dict | None:
        """The notice that the words from ``first`` to ``end`` are, if they have the template's wording.

        Names of licences and versions must all be there and no others, and nothing may say "not".
        """
        template, own = self.wanted[name], words[first:end]
        n = len(template)
        steps = SequenceMatcher(None, template, own, autojunk=False).get_opcodes()
        equal = [s for s in steps if s[0] == "equal"]
        cover = sum(b - a for _, a, b, _, _ in equal) / n
        if cover < self.least_cover:
            return None
        begin, stop = first + equal[0][3], first + equal[-1][4]
        inner = [s for s in steps if s[0] != "equal" and not (s[0] == "insert" and s[1] in (0, n))]
        lost = [w for _, a, b, _, _ in inner for w in template[a:b]]
        # beyond the first and last equal words stands what replaces the template's, not what was put in
        put_in = [w for _, a, b, c, d in inner if 0 < a and b < n for w in own[c:d]]
        if any(map(self.telling, lost)) or any(self.telling(w) or w in NEGATIONS for w in put_in):
            return None
        if NEGATIONS.intersection(words[max(0, begin - 2) : begin]):
            return None
        changes = [f"-{' '.join(template[a:b])} +{' '.join(own[c:d])}" for _, a, b, c, d in inner]
        return {"span": (begin, stop), "license": name, "cover": round(cover, 4), "differences": changes}

    def telling(self, word: str) -> bool:
        return word in self.names or any(c.isdigit() for c in word)

    def blocks(self, name: str, words: list[str], hits: list[tuple[int, int]], wins) -> None:
        """Offers ``wins`` the candidate blocks of a template: first the exact ones, then others between them.

        A block goes from where the template would begin by the first pair of its words to where it would
        end by the last one; ``wins`` says where the notice ends that was found there, if any.
        """
        template, slack = self.wanted[name], self.slack[name]
        n, taken = len(template), []
        for start in sorted({i - k for i, k in hits}):
            if start >= 0 and words[start : start + n] == template and not (taken and start < taken[-1][1]):
                if wins(start, start + n):
                    taken.append((start, start + n))
        begins, at, done, failed = [b for b, _ in taken], [i for i, _ in hits], 0, set()
        for i, k in hits:
            j = bisect_left(begins, i + 1)
            if i < done or j and i < taken[j - 1][1] or i - k in failed:
                continue
            floor = max(done, taken[j - 1][1] if j else 0)
            ceiling = begins[j] if j < len(begins) else len(words)
            center, end = i - k, None
            for _ in range(2):  # around this pair, then around where most of those in order with it are
                low, high = max(floor, center - slack), min(ceiling, center + n + slack)
                near = hits[bisect_left(at, low) : bisect_left(at, high)]
                aligned = in_order(near) if len({q for _, q in near}) >= self.least_pairs[name] else []
                if len(aligned) < self.least_pairs[name]:
                    break
                center = Counter(x - q for x, q in aligned).most_common(1)[0][0]
            else:
                (x, q), (y, r) = aligned[0], aligned[-1]
                end = wins(max(floor, x - q), min(ceiling, y - r + n))
            if end:
                done = max(done, end)
            else:
                failed.add(i - k)

    def scan(self, text: str) -> list[dict]:
        """The notices of all templates, but none inside the words of one that saves more."""
        lower = text.lower()
        words = WORD.findall(lower)
        anchored = self.anchored(words)
        if not any(len(hits) >= self.least_pairs[name] for name, hits in anchored.items()):
            return []
        starts = {name: [i for i, _ in hits] for name, hits in anchored.items()}
        tried: dict[tuple[int, int], dict | None] = {}

        def wins(first: int, end: int) -> int | None:
            """Ranks all templates with words in the block; the best one that has the wording wins."""
            if (first, end) not in tried:
                here = [x for x, at in starts.items() if bisect_left(at, first) < bisect_left(at, end - 1)]
                tried[first, end] = None
                for saved, share, name in self.ranked(" ".join(words[first:end]), here):
                    if share < self.least_reduction:
                        break
                    if found := self.worded(name, words, first, end):
                        tried[first, end] = {"saved": saved, "reduction": round(share, 4), **found}
                        break
            found = tried[first, end]
            return found and found["span"][1]

        for name, hits in anchored.items():
            if len(hits) >= self.least_pairs[name]:
                self.blocks(name, words, hits, wins)
        # exact wording settles what compression ranks alike
        found = sorted(
            (x for x in tried.values() if x),
            key=lambda x: (-x["saved"], len(x["differences"]) > 0, -x["cover"], x["license"], x["span"]),
        )
        kept: list[dict] = []
        for x in found:
            first, end = x["span"]
            inside = (y["span"][0] <= first and end <= y["span"][1] for y in kept)
            same = (y["license"] == x["license"] and y["span"][0] < end and first < y["span"][1] for y in kept)
            if not any(inside) and not any(same):
                kept.append(x)
        if not kept:
            return []
        at = [m.span() for m in WORD.finditer(lower)]
        out = []
        for x in sorted(kept, key=lambda x: (x["span"], x["license"])):
            del x["saved"]
            first, end = x.pop("span")
            line = lower.count("\n", 0, at[first][0])
            out.append({"line": line, "lines": lower.count("\n", at[first][0], at[end - 1][1]) + 1, **x})
        return out


FOUND = pa.schema(
    [("line", pa.int64()), ("lines", pa.int64()), ("license", pa.string()), ("reduction", pa.float64())]
    + [("cover", pa.float64()), ("differences", pa.list_(pa.string()))]
)


def _scanned(templates: dict[str, str], least_reduction: float, least_cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"licenses {sorted(templates)} {least_reduction} {least_cover}"
        scanner = per_worker(name, lambda: Scanner(templates, least_reduction, least_cover))
        for batch in batches:
            owners, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                hits = scanner.scan(text or "")
                owners += [k] * len(hits)
                found += hits
            rows = pa.RecordBatch.from_pylist(found, FOUND)
            ids = batch.column(0).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *rows.columns], ["doc_id", *FOUND.names])

    return run


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    least_reduction: float = 0.3,
    least_cover: float = 0.85,
) -> DataFrame:
    """A row per notice: ``doc_id``, ``line``, ``lines``, ``license``, ``reduction``, ``cover``, ``differences``.

    All of every text is looked at; without shuffle. A notice may begin and end inside a line and go over
    line ends and blank lines; up to half as many words as it has, and three, may be put in between. A
    text has a row for each of its notices, but none for one inside the words of a better one.
    ``reduction`` is what share of the compressed size of the block's words the template saves, at least
    ``least_reduction``; ``cover`` the share of the template's words found in order, at least ``least_cover``;
    ``differences`` lists wording that was taken away, with what stands in its place, or added inside the
    notice (empty: exact). Licence names and versions must be equal; a denied notice is none.

    NULL and empty texts, and those without notice, give no rows; identifiers may be NULL or repeated.
    Texts may be of any length. Other columns are not looked at.
    """
    rows = plain(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scanned(templates or TEMPLATES, least_reduction, least_cover),
        f"doc_id {kind}, line long, lines long, license string, reduction double, cover double, differences array<string>",
    )


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{folder}/documents.parquet")).withColumn(
        "differences", F.array_join("differences", "; ")
    )


QUERIES = {"op2_license_scan": op2_license_scan}

SQL: dict[str, str] = {}
