"""Stored pages, their texts and embedded ids."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.operators.pages import contact_pages, with_page_text, with_profile_id
from postbag.plans.tables import table
from postbag.sources.pages import read_pages


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(spark, f"{folder}/pages.parquet")


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return with_page_text(_pages(spark, folder), "article", parsed=False).select("page_id", "page_text")


def page_text_html(spark: SparkSession, folder: str) -> DataFrame:
    return with_page_text(_pages(spark, folder), "article").select("page_id", "page_text")


def page_text_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that came without encryption get a nested article, whose text comes twice."""
    nested = F.replace("html", F.lit("</article>"), F.lit("<article>Caf&eacute;</article></article>"))
    html = F.when(F.col("url").startswith("http:"), nested).otherwise(F.col("html"))
    return with_page_text(_pages(spark, folder).withColumn("html", html), "article").select("page_id", "page_text")


def _data_page() -> Column:
    """An event as a page: a broken block, one with the id (errors none, sign-ups an empty list), one more."""
    marker = F.lit(S.ID_MARKER)
    head = F.concat(F.lit('{"data":{"data":{"'), marker, F.lit('":{"*elements":['))
    first = F.concat(F.lit('"urn:li:x:'), "event_type", F.lit("-"), "event_id", F.lit('"'))
    elements = F.when(F.col("event_type") == "signup", F.lit("")).otherwise(F.concat(first, F.lit(',"urn:li:x:no"')))
    block = F.concat(F.lit("<code>"), head, elements, F.lit("]}}}}</code>"))
    later = F.when(
        F.col("event_type") == "click",
        F.concat(F.lit("<code id='c'>"), head, F.lit("&quot;urn:li:x:late&quot;]}}}}</code>")),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("<body><code>{bad "),
        marker,
        F.lit("</code><code>"),
        "props",
        F.lit("</code>"),
        F.when(F.col("event_type") == "error", F.lit("<p>none</p>")).otherwise(block),
        later,
        F.lit("</body>"),
    )


def embedded_id(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "events").select("event_id", _data_page().alias("html"))
    return with_profile_id(pages).select("event_id", "profile_id")


def found_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts for every stored page, and every customer as one whose page was never stored."""
    pages = _pages(spark, folder)
    contacts = pages.select(F.col("page_id").alias("row_pos"), F.col("url").alias("profile_url")).unionByName(
        table(spark, folder, "customer").select(
            (-1 - F.col("c_custkey")).alias("row_pos"), F.col("c_name").alias("profile_url")
        )
    )
    return contact_pages(contacts, pages).select("row_pos", "profile_url", "page_id", "html")


QUERIES = {
    "page_text": page_text,
    "page_text_html": page_text_html,
    "page_text_nested": page_text_nested,
    "embedded_id": embedded_id,
    "contact_pages": found_pages,
}

_BLANK = r"\s\x{A0}"


def sql_page_text() -> str:
    """The data has one article per page, and escapes only quotes and ampersands."""
    unseen = (
        r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>"
        r"|<template(?:\s[^>]*)?>.*?</template\s*>|<!--.*?-->"
    )
    seen = f"regexp_replace(html, '{unseen}', '<x>', 'g')"
    inner = rf"regexp_extract({seen}, '(?is)<article(?:\s[^>]*)?>(.*?)</article\s*>', 1)"
    text = "regexp_replace(regexp_replace(t, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
    trimmed = rf"regexp_replace({text}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"
    pieces = f"list_transform(string_split_regex({inner}, '<[a-zA-Z/!?][^>]*>'), lambda t: {trimmed})"
    joined = f"array_to_string(list_filter({pieces}, lambda t: t <> ''), ' ')"
    return f"SELECT page_id, {joined} AS page_text FROM pages"


SQL = {
    "page_text": sql_page_text(),
    "page_text_html": sql_page_text(),
    "page_text_nested": f"""
      SELECT page_id, CASE WHEN url LIKE 'http:%'
        THEN ltrim(page_text || ' Café', ' ') || chr(10) || 'Café' ELSE page_text END AS page_text
      FROM ({sql_page_text()}) JOIN pages USING (page_id)""",
    "embedded_id": """
      SELECT event_id, CASE WHEN event_type IN ('view', 'purchase', 'click') THEN event_type || '-' || event_id END
        AS profile_id FROM events""",
    "contact_pages": """
      WITH contacts AS (SELECT page_id AS row_pos, url AS profile_url FROM pages
                        UNION ALL SELECT -1 - c_custkey, c_name FROM customer)
      SELECT row_pos, profile_url, page_id, html FROM contacts LEFT JOIN pages ON url = profile_url""",
}
