import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.functions import html

K = S.ID_MARKER


def ids(*values):
    listed = ",".join(f'"{v}"' for v in values)
    return f'<code>{{"data":{{"data":{{"{K}":{{"*elements":[{listed}]}}}}}}}}</code>'


PAGES = [
    ("<main> <h1>A</h1><p> b </p></main>", "A b"),
    ("<main>a<script>x</main></script><!--y-->b</main>", "a b"),
    ("<main>a</main><main class='x'>b</main>", "a\nb"),
    ("<main> </main>", ""),
    ("<p>z</p>", ""),
    ('<main>a &amp; b &amp c &quot;d&quot; &lt;e&gt; &amp;lt; &nbsp;</main>', 'a & b & c "d" <e> &lt;'),
    ("<main>a<b>b</b><template><p>t</p></template><style>s</style>\n c </main>", "a b c"),
    ("<mainly>no</mainly><MAIN>yes<br/>1 < 2</MAIN>", "yes 1 < 2"),
]


PLAIN = ["<p>", "</p>", "<br/>", "<b class='x'>", "&amp;", "&amp", "&lt;b&gt;", "&nbsp;", "text", "Ärger", " ", "\n",
         "<script>if (a<b) {}</script>", "<style>p{}</style>", "<!-- c -->", "<template><b>t</b></template>", "1 < 2"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PLAIN), max_size=12), min_size=300, max_size=300))
def test_patterns_read_plain_pages_like_the_parser(spark, pages):
    whole = ["<p>x</p><main>" + "".join(p) + "</main>" + ("<main>two</main>" if len(p) % 2 else "") for p in pages]
    df = spark.createDataFrame(list(enumerate(whole)), "i int, page string")
    got = df.select("i", html.element_text(F.col("page")).alias("t")).orderBy("i").collect()
    wrong = [(whole[r.i], r.t) for r in got if r.t != html.parse_element_text(whole[r.i])]
    assert not wrong, wrong[0]


@pytest.mark.parametrize("extract", [html.element_text, html.element_text_parsed])
def test_texts(spark, extract):
    pages = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PAGES)], "i int, page string")
    got = [r.t for r in pages.select("i", extract(F.col("page")).alias("t")).orderBy("i").collect()]
    assert got == [p[1] for p in PAGES]


def test_nested_elements_need_the_parser(spark):
    page = spark.createDataFrame([("<main>a<main>b</main></main>",), (None,)], "page string")
    got = [r.t for r in page.select(html.element_text_parsed(F.col("page")).alias("t")).collect()]
    assert got == ["a b\nb", None]


@pytest.mark.parametrize(
    "page, want",
    [
        (ids("urn:li:x:ABC", "urn:li:x:DEF"), "ABC"),
        (f"<code>{{bad {K}</code>" + ids("urn:li:x:ABC"), "ABC"),
        (ids("a:1") + ids("a:2"), "1"),
        (ids() + ids("a:2"), "2"),
        (ids("a:1").replace('"', "&quot;"), "1"),
        (ids(), None),
        ("<code>{}</code>", None),
        ("<p>none</p>", None),
        ('<code>{"data":{"data":{"other":{"*elements":["a:1"]}}}}</code>', None),
    ],
)
def test_ids(spark, page, want):
    assert spark.createDataFrame([(page,)], "p string").select(html.first_match(F.col("p"))).first()[0] == want


def test_ids_come_from_whole_json_only(spark):
    good = '{"data": {"data": {"%s": {"*elements": ["urn:x:%s"]}}}}'
    first = good % (S.ID_MARKER, "A")
    broken = [first + " x", first + first, first + "," + first, first.replace('"', "'"), first[:-1]]
    rows = [(f"<code>{b}</code><code>{good % (S.ID_MARKER, 'B')}</code>",) for b in broken] + [(f"<code> {first}\n</code>",)]
    got = spark.createDataFrame(rows, "h string").coalesce(1).select(html.first_match(F.col("h")).alias("i"))
    assert [r.i for r in got.collect()] == ["B"] * len(broken) + ["A"]


def test_bodies(spark):
    page = "<code id='a'>x &amp; &quot;y&quot;</code><code></code>"
    got = spark.createDataFrame([(page,)], "p string").select(html.element_bodies(F.col("p"))).first()[0]
    assert got == ['x &amp; "y"', ""]
