"""String functions."""

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag import schema as S

# White space as Unicode has it, plus the four separators U+001C to U+001F.
_SPACE = r"[\s\x1C-\x1F]"
# Anchored to the start of each blank run, so that long inner runs are looked at once only.
_EDGES = rf"(?U)\A{_SPACE}++|(?<!{_SPACE}){_SPACE}++\z"
# Everything but letters, numbers of any kind, underscore, white space and hyphen.
_NOT_SLUG = r"(?U)[^\p{L}\p{N}_\s\x1C-\x1F-]"


def lower(c: Column) -> Column:
    return F.lower(c)


def strip(c: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.regexp_replace(c, _EDGES, "")


def slugify(c: Column) -> Column:
    """Company name to host name: drop odd characters, lower, each space to a hyphen."""
    return F.replace(F.lower(F.regexp_replace(c, _NOT_SLUG, "")), F.lit(" "), F.lit("-"))


def infer_email(first_name: Column, last_name: Column, company: Column) -> Column:
    """``first.last@slug.com``; NULL as soon as one part is missing."""
    return F.concat(
        F.lower(first_name), F.lit("."), F.lower(last_name), F.lit("@"), slugify(company), F.lit(".com")
    )


def default_if_blank(c: Column, default: str | Column) -> Column:
    """Stripped text, or the default where nothing is left."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(strip(c), F.lit("")), fallback)


def split_last(c: Column, separator: str = ":") -> Column:
    """The part after the last separator; the whole text if there is none."""
    return F.substring_index(c, separator, -1)


def join_lines(parts: Column) -> Column:
    """Non-empty array elements, one per line."""
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "\n")


def chunk_text(c: Column, size: int = S.CHUNK_CHARS) -> Column:
    """Consecutive pieces of ``size`` characters; no pieces for an empty text."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    # Sliced by characters once over the text rather than by substring from the start per piece.
    return F.regexp_extract_all(c, F.lit(rf"(?s)(.{{1,{size}}})"), 1)


def preview(c: Column, size: int = S.PREVIEW_CHARS) -> Column:
    return F.concat(F.substring(c, 1, size), F.lit("..."))


def title_text(c: Column) -> Column:
    """``error_message`` to ``Error Message``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def profile_link(profile_id: Column, prefix: str = S.PROFILE_LINK_PREFIX) -> Column:
    return F.concat(F.lit(prefix), profile_id)


def contains_marker(c: Column, marker: str = S.ID_MARKER) -> Column:
    return F.contains(c, F.lit(marker))


def fill_template(template: str | Column, **values: Column) -> Column:
    """Put values into ``{name}`` places, literally and in one pass.

    A Python template is cut into pieces here, so braces inside a value are never looked at. A
    template held in a column takes a single name.
    """
    if isinstance(template, Column):
        if len(values) != 1:
            raise ValueError("a template column takes exactly one value")
        ((name, value),) = values.items()
        return F.replace(template, F.lit("{" + name + "}"), value)
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            if name not in values:
                raise ValueError(f"template names {{{name}}}, but no such value was given")
            pieces.append(values[name])
    return F.concat(*pieces) if pieces else F.lit("")
