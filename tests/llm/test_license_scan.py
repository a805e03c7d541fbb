"""Licence scan: ranks by compression decide, names and versions must be equal, and every window by brute force."""

import random
import string

import pytest
from brute import licenses

from postbag.llm.license_scan import TEMPLATES, Scanner, scan_licenses

SHORT = {name: text for name, text in TEMPLATES.items() if len(text) < 110}
PROSE = "of the many works to the east under the hill we say licensed or public domain version 2 and 4.0 here".split()
GPL = TEMPLATES["GPL-3.0"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under the Apache License, Version 1.1.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", []),
        ("This work is licensed under the GNU General Public License, version 1.", []),
        ("Licensed under CC BY-NC-ND 4.0.", ["CC-BY-NC-ND-4.0"]),
        ("Licensed under CC BY-NC-ND 3.0.", []),
        (GPL.replace("is licensed", "is not licensed"), []),
        ("Not released under the MIT License.", []),
        (GPL.replace("version 3.", "version 3 or later."), ["GPL-3.0"]),
        (TEMPLATES["GPL-2.0"] + " " + GPL, ["GPL-2.0", "GPL-3.0"]),
    ],
)
def test_names_versions_and_denials(text, want):
    scanner = Scanner(TEMPLATES, 0.3, 0.85)
    for around in ("", "some words of the page before it "):
        assert [x["license"] for x in scanner.scan(around + text)] == want


def test_what_stands_in_place_of_words_is_told():
    found = Scanner(TEMPLATES, 0.3, 0.85).scan(TEMPLATES["Unlicense"].replace("public domain", "public sphere"))
    assert [x["differences"] for x in found] == [["-domain +sphere"]]


def test_compression_decides():
    """All the words in order, but drowned in others: the wording would do, what the template saves would not."""
    words = TEMPLATES["ISC"].split()
    r = random.Random(1)
    junk = ["".join(r.choices(string.ascii_lowercase, k=40)) for _ in words]
    drowned = " ".join(w + (f" {junk[i]}" if i % 2 else "") for i, w in enumerate(words))
    assert Scanner(TEMPLATES, 0.3, 0.85).scan(drowned) == []
    assert [x["license"] for x in Scanner(TEMPLATES, -9, 0.85).scan(drowned)] == ["ISC"]


def test_every_template_in_a_block_is_ranked():
    scanner = Scanner(TEMPLATES, 0.3, 0.85)
    asked = []
    ranked = scanner.ranked
    scanner.ranked = lambda text, names: asked.append(set(names)) or ranked(text, names)
    assert [x["license"] for x in scanner.scan(TEMPLATES["AGPL-3.0"])] == ["AGPL-3.0"]
    assert any({"AGPL-3.0", "LGPL-3.0", "GPL-3.0", "GPL-2.0", "GPL-notice"} <= names for names in asked)
    best = ranked(" ".join(scanner.wanted["AGPL-3.0"]), ["GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MIT"])
    assert best[0][2] == "AGPL-3.0" and best[-1][2] == "MIT"


def test_same_as_every_window_by_brute_force():
    r = random.Random(3)
    scanner = Scanner(SHORT, 0.3, 0.85)
    for _ in range(60):
        text = []
        for _ in range(r.randrange(3)):
            text += r.sample(PROSE, r.randrange(8, 14))
            words = r.choice(list(SHORT.values())).split()
            for _ in range(r.randrange(3)):
                k = r.randrange(1, len(words) - 1)
                words[k : k + r.randrange(2)] = r.choice([[], ["not"], ["duly"], ["2.0"], ["Lesser"]])
            text += words
        text = " ".join(text + r.sample(PROSE, r.randrange(10)))
        assert [x["license"] for x in scanner.scan(text)] == licenses(scanner, text), text


def test_odd_tables(spark):
    mit = TEMPLATES["MIT"]
    rows = [(1, mit, "x", 0.5), (1, mit, "x", 0.5), (None, mit, None, None), (2, None, "x", 0.1), (3, "", "x", 0.1)]
    rows.append((4, "of the " * 100_000 + mit, "x", 0.2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, reduction double")
    got = sorted((r.doc_id or 0, r.license) for r in scan_licenses(docs).collect())
    assert got == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (4, "MIT")]
    assert scan_licenses(docs.where("false")).collect() == []
