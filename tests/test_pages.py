"""Pages of contacts: read late, one per URL; contacts of one URL spread over tasks."""

import pytest
from pyspark.sql import functions as F

from postbag.operators.addresses import resolve_address
from postbag.operators.pages import contact_pages, needed_pages
from postbag.operators.skew import places


@pytest.fixture
def crawl(spark):
    url = F.concat(F.lit("http://x/"), F.col("id") % 3000)
    return spark.range(6000).select(F.col("id").alias("page_id"), url.alias("url"), F.repeat(F.lit("h"), 50).alias("html"))


def wanted(spark, urls):
    return spark.createDataFrame([("r", i, u) for i, u in enumerate(urls)], "run_id string, row_pos long, profile_url string")


@pytest.mark.parametrize("bits", [1, 64, 1 << 26])
def test_the_last_page_of_each_url_whatever_the_filter(spark, crawl, bits):
    contacts = wanted(spark, ["http://x/7", "http://x/7", "http://x/2999", "http://none/", None])
    got = sorted((r.page_id, r.url, r.html) for r in needed_pages(contacts, crawl, bits).collect())
    assert got == [(3007, "http://x/7", "h" * 50), (5999, "http://x/2999", "h" * 50)]
    assert needed_pages(contacts.where("false"), crawl).count() == 0
    assert needed_pages(contacts, crawl.where("false")).count() == 0


def test_pages_nobody_asked_for_do_not_move(spark, crawl, tmp_path):
    """Few rows reach an exchange that carries html, and the scan of URLs alone reads no html."""
    crawl.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        needed = needed_pages(wanted(spark, [f"http://x/{i}" for i in range(5)]), pages)
        assert needed.count() == 5
        needed.collect()
        text = needed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moving = text[text.index("Exchange hashpartitioning(url") :]
    first = moving[: moving.index("Exchange hashpartitioning(url", 1)]
    filtered = next(line for line in first.splitlines() if "BroadcastHashJoin" in line)
    assert "getbit" in filtered and "html" in first[first.index("FileScan") :]
    assert "html" not in moving[len(first) :]


def test_contacts_at_the_same_place_of_many_runs_are_told_apart(spark):
    contacts = wanted(spark, ["u"])
    assert places(contacts) == ["run_id", "row_pos"] and places(contacts.drop("run_id")) == ["row_pos"]
    many = spark.range(500).select(F.col("id").cast("string").alias("run_id"), F.lit(0).alias("row_pos"), F.lit("u").alias("profile_url"))
    hot = spark.createDataFrame([("u", 8)], "profile_url string, _slices int")
    pages = spark.createDataFrame([("u", 1, "h")], "url string, page_id long, html string")
    assert contact_pages(many, pages, hot=hot).where("page_id = 1").count() == 500


def test_a_profile_twice_on_file_gives_a_contact_once(spark):
    fields = "run_id string, row_pos long, profile_url string, email string, first_name string, last_name string, company string"
    contacts = spark.createDataFrame([("r", 0, "u", None, "A", "B", "C"), ("r", 1, "v", "e@x", "A", "B", "C"), ("r", 2, None, "n@x", "A", "B", "C")], fields)
    on_file = spark.createDataFrame([("u", "old@x", 1), ("u", "new@x", 2), ("u", None, 3), ("v", None, 1), (None, "no@x", 1)], "profile_url string, on_file string, at int")
    got = {r.row_pos: (r.address, r.address_source) for r in resolve_address(contacts, on_file, order=["at"]).collect()}
    assert got == {0: ("new@x", "on_file"), 1: ("e@x", "supplied"), 2: ("n@x", "supplied")}
    assert resolve_address(contacts, on_file).where("row_pos = 0").collect()[0].address == "old@x"
