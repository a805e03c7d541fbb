"""Text and embedded data out of stored HTML."""

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.functions.text import contains_marker, join_lines, split_last, strip

_UNSEEN = r"(?is)<(script|style|template)(?:\s[^>]*)?>.*?</\1\s*>|<!--.*?-->"
_MARKUP = r"<[a-zA-Z/!?][^>]*>"
# Characters an HTML writer must escape; the ampersand comes last so that nothing is read twice.
_ENTITIES = (
    (r"&quot;?|&#34;|&#[xX]22;", '"'),
    (r"&apos;|&#39;|&#[xX]27;", "'"),
    (r"&lt;?|&#60;", "<"),
    (r"&gt;?|&#62;", ">"),
    (r"&nbsp;?|&#160;", " "),
    (r"&amp;?|&#38;", "&"),
)


def _element(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"


def _unescape(c: Column) -> Column:
    out = c
    for pattern, char in _ENTITIES:
        out = F.regexp_replace(out, pattern, char)
    return F.when(F.contains(c, F.lit("&")), out).otherwise(c)


def _node_texts(inner: Column) -> Column:
    texts = F.transform(F.split(inner, _MARKUP), lambda t: strip(_unescape(t)))
    return F.array_join(F.filter(texts, lambda t: F.length(t) > 0), " ")


def element_texts(html: Column, tag: str = "main") -> Column:
    """One text per ``<tag>`` element: its text nodes stripped, blanks dropped, joined by a space.

    Scripts, styles, templates and comments are not text. Elements of the same tag must not be
    nested and attributes must not hold ``>``; ``element_text_parsed`` takes those.
    """
    seen = F.regexp_replace(html, _UNSEEN, "<x>")
    return F.transform(F.regexp_extract_all(seen, F.lit(_element(tag)), 1), _node_texts)


def element_text(html: Column, tag: str = "main") -> Column:
    """Texts of all ``<tag>`` elements, one per line; empty text if there are none."""
    return join_lines(element_texts(html, tag))


def element_bodies(html: Column, tag: str = "code") -> Column:
    """What stands inside each ``<tag>``, as a browser gives it back (quotes are not escaped)."""
    bodies = F.regexp_extract_all(html, F.lit(_element(tag)), 1)
    plain_quotes = lambda b: F.regexp_replace(F.regexp_replace(b, _ENTITIES[0][0], '"'), _ENTITIES[1][0], "'")
    return F.transform(bodies, lambda b: F.when(F.contains(b, F.lit("&")), plain_quotes(b)).otherwise(b))


def json_path_value(body: Column, key: str = S.ID_MARKER) -> Column:
    """First of ``data.data.<key>.*elements``; NULL for broken JSON, a missing key or an empty list.

    The whole body must be one JSON value: text after it, single-quoted strings and repeated keys count
    as broken, and so does a body too large for a variant.
    """
    # As the only element of a list, since the reader of a bare value does not look behind it.
    alone = F.concat(F.lit("["), body, F.lit("]"))
    sound = (F.json_array_length(alone) == 1) & F.try_parse_json(alone).isNotNull()
    return F.when(sound, F.get_json_object(body, f"$.data.data.{key}['*elements'][0]"))


def first_match(html: Column, key: str = S.ID_MARKER, tag: str = "code") -> Column:
    """Id from the first ``<tag>``, in page order, that yields one."""
    # Most pages of a crawl hold no such data; they are told apart before any pattern is tried.
    marked = F.when(contains_marker(html, key), html)
    bodies = F.filter(element_bodies(marked, tag), lambda b: contains_marker(b, key))
    ids = F.transform(bodies, lambda b: split_last(json_path_value(b, key)))
    return F.nullif(F.get(F.filter(ids, lambda i: i.isNotNull()), F.lit(0)), F.lit(""))


class _TagText(HTMLParser):
    """Collects the text nodes of every ``tag`` element, also of nested ones."""

    _VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    _UNSEEN = frozenset(("script", "style", "template"))

    def __init__(self, tag: str):
        super().__init__(convert_charrefs=True)
        self._tag = tag
        self._open: list[str] = []
        self._elements: list[list[str]] = []
        self._live: list[list[str]] = []
        self._run: list[str] = []
        self._hidden = 0

    def _end_node(self) -> None:
        text = "".join(self._run).strip()
        self._run = []
        if text:
            for parts in self._live:
                parts.append(text)

    def handle_starttag(self, tag, attrs):
        self._end_node()
        if tag in self._VOID:
            return
        self._open.append(tag)
        if tag in self._UNSEEN:
            self._hidden += 1
        if tag == self._tag:
            self._elements.append([])
            self._live.append(self._elements[-1])

    def handle_startendtag(self, tag, attrs):
        # A slash does not close an element that may hold content.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end_node()
        if tag not in self._open:
            return
        while True:
            closed = self._open.pop()
            if closed in self._UNSEEN:
                self._hidden -= 1
            if closed == self._tag:
                self._live.pop()
            if closed == tag:
                return

    def handle_data(self, data):
        if not self._hidden and self._live:
            self._run.append(data)

    def handle_comment(self, data):
        self._end_node()

    def handle_decl(self, decl):
        self._end_node()

    def texts(self) -> list[str]:
        self._end_node()
        return [t for t in (" ".join(parts) for parts in self._elements) if t]


def parse_element_text(html: str | None, tag: str = "main") -> str | None:
    if html is None:
        return None
    parser = _TagText(tag)
    parser.feed(html)
    parser.close()
    return "\n".join(parser.texts())


def element_text_parsed(html: Column, tag: str = "main") -> Column:
    """As ``element_text``, by a real parser in Python: for nested tags and all entities.

    Pages go to it a hundred at a time: an Arrow batch has up to 10,000, whatever their length.
    """
    parse = F.udf(lambda page: parse_element_text(page, tag), "string", useArrow=False)
    return parse(html)
