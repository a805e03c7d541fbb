"""Contacts with their stored page, its text and its embedded id."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.functions.html import element_text, element_text_parsed, first_match
from postbag.operators.skew import places, salted_join

#: Bits of the filter of needed pages: 8 MB at most.
FILTER_BITS = 1 << 26


def contact_pages(
    contacts: DataFrame,
    pages: DataFrame,
    spread: Sequence[str] | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Each contact with the page at its URL, NULLs if none is stored. One page per URL.

    Contacts of one URL are spread by ``spread``, their run and position unless given.
    """
    spread = places(contacts) if spread is None else spread
    at_url = pages.withColumnRenamed("url", "profile_url")
    return salted_join(contacts, at_url, ["profile_url"], spread, "left", hot)


def needed_pages(contacts: DataFrame, pages: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The pages at the contacts' URLs, one per URL: the one stored last, by ``page_id``.

    Taken before pages are parsed, so that a run never parses the rest of a crawl. Which pages they are is
    found from URLs and ids alone, and written. A filter made from that, of ``bits`` bits and so of a fixed size
    however many contacts there are, keeps ``html`` of other pages out of the join, but for as many as share a bit
    with one that is needed; the join itself is exact.
    """
    wanted = contacts.select(F.col("profile_url").alias("url")).distinct()
    last = pages.join(wanted, "url", "left_semi").groupBy("url").agg(F.max("page_id").alias("page_id"))
    last = workspace.keep(last, "needed-pages")
    place = F.pmod(F.xxhash64("url", "page_id"), F.lit(bits)) + 1
    bitmaps = last.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bitmap")
    )
    # 4 KB a bucket of 2^15 bits: never more than bits / 8 bytes
    filtered = pages.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps), "_bucket")
    bit = F.bitmap_bit_position(place)
    byte = F.expr("substring(_bitmap, int(_bit div 8) + 1, 1)")
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("_bit") % 8).cast("int")) == 1
    hits = filtered.withColumn("_bit", bit).where(held).select(pages.columns)
    # one row a page in ``last``; a semi-join would be taken before the filter
    return hits.join(last, ["url", "page_id"]).select(pages.columns)


def with_page_text(pages: DataFrame, tag: str = "main", parsed: bool = True) -> DataFrame:
    """Add ``page_text``, by the parser or, for plain pages, by patterns inside the JVM."""
    extract = element_text_parsed if parsed else element_text
    return pages.withColumn("page_text", extract(F.col("html"), tag))


def with_profile_id(pages: DataFrame, key: str = S.ID_MARKER) -> DataFrame:
    return pages.withColumn("profile_id", first_match(F.col("html"), key))
