import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.functions import labels, text
from postbag.operators import drafts

SLUGS = {
    "O’Reilly": "oreilly",
    "a_b-c": "a_b-c",
    "x\ty": "x\ty",
    "① two": "①-two",
    "½ price": "½-price",
    "école": "ecole",
    "a‍b‿c": "abc",
    "🙂 co": "-co",
    "ΑΣ Ltd": "ας-ltd",
    "Acme, Inc.": "acme-inc",
    "A  B & Co": "a--b--co",
    "Müller GmbH": "müller-gmbh",
    "": "",
}


def values(spark, cells, column):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in rows.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_slugs(spark):
    assert values(spark, SLUGS, text.slugify) == list(SLUGS.values())


ODD = st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40)


@settings(max_examples=5, deadline=None)
@given(st.lists(ODD, min_size=60, max_size=60))
def test_against_plain_python(spark, cells):
    cells = cells + [c + "  \x1f" for c in cells]
    assert values(spark, cells, text.strip) == [c.strip() for c in cells]
    assert values(spark, cells, lambda c: text.chunk_text(c, 7)) == [
        [c[i : i + 7] for i in range(0, len(c), 7)] for c in cells
    ]
    assert values(spark, cells, text.preview) == [c[:100] + "..." for c in cells]
    assert values(spark, cells, drafts.word_count) == [len(c.split()) for c in cells]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aZ _-é.½①ß\t ", max_size=20), min_size=60, max_size=60))
def test_slug_against_plain_python(spark, cells):
    assert values(spark, cells, text.slugify) == [
        re.sub(r"[^\w\s-]", "", c).lower().replace(" ", "-") for c in cells
    ]


def test_long_blank_runs_are_quick(spark):
    blanks = "a" + " " * 200_000 + "b"
    assert values(spark, [blanks, " " * 200_000], text.strip) == [blanks, ""]


def test_addresses(spark):
    rows = spark.createDataFrame(
        [("Bo", "Ray", "Acme, Inc."), ("Zoë", "Groß", "Müller GmbH"), ("Al", None, "Y"), ("Al", "Fox", "360")],
        "f string, l string, c string",
    )
    got = [r[0] for r in rows.select(text.infer_email(F.col("f"), F.col("l"), F.col("c"))).collect()]
    assert got == ["bo.ray@acme-inc.com", "zoë.groß@müller-gmbh.com", None, "al.fox@360.com"]


def test_defaults(spark):
    assert values(spark, [" hi \n", " 　", None], lambda c: text.default_if_blank(c, "d")) == ["hi", "d", "d"]


def test_chunks(spark):
    cells = ["", "x" * 20, "x" * 41, "🙂" * 21]
    assert [len(v) for v in values(spark, cells, text.chunk_text)] == [0, 1, 3, 2]
    with pytest.raises(ValueError):
        text.chunk_text(F.lit("x"), 0)


def test_templates(spark):
    cells = ["{b} and {a}", "plain"]
    assert values(spark, cells, lambda c: text.fill_template("<{a}|{b}>{{x}}", a=c, b=F.lit("{a}"))) == [
        "<{b} and {a}|{a}>{x}",
        "<plain|{a}>{x}",
    ]
    assert values(spark, ["{a}{a}"], lambda c: text.fill_template(c, a=F.lit("{a}"))) == ["{a}{a}"]
    with pytest.raises(ValueError):
        text.fill_template("{other}", a=F.lit("x"))
    with pytest.raises(ValueError):
        text.fill_template(F.lit("{a}"), a=F.lit("x"), b=F.lit("y"))


def test_small_functions(spark):
    assert values(spark, ["a:b:c", "abc"], text.split_last) == ["c", "abc"]
    assert values(spark, ["error_message"], text.title_text) == ["Error Message"]
    assert values(spark, ["X1"], text.profile_link) == [S.PROFILE_LINK_PREFIX + "X1"]
    assert values(spark, ["x"], lambda c: text.join_lines(F.array(c, F.lit(""), c))) == ["x\nx"]
    assert values(spark, ["25", "abc", None], lambda c: labels.int_or_default(c, 100)) == [25, 100, 100]
    assert values(spark, ["x"], lambda c: labels.as_text(F.lit(7))) == ["7"]


def test_channels(spark):
    cells = [
        " Send immediately via InMail ",
        "x Send immediately via Email",
        "Send immediately via Email, Send immediately via InMail",
        "Send later",
    ]
    assert values(spark, cells, labels.label_channel) == ["InMail", "Email", "InMail", "unknown"]


def test_decision_labels(spark):
    keys = ["Enter", "Backspace", "Shift", None]
    assert values(spark, keys, labels.label_decision) == ["go", "skip", "unrecognized", None]
    assert values(spark, ["Enter", "a"], labels.ends_review) == [True, False]
