"""What the physical plans must and must not hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postbag import workspace
from postbag.operators import decisions, history, quota
from postbag.operators.addresses import resolve_address
from postbag.plans.contact_queries import customer_contacts
from postbag.sources import logs

# Queries that read back what they wrote, and the two that need Python on purpose.
WRITTEN = {
    "contact_file_checks", "stream_contacts", "outbox_by_day", "log_append", "personalized",
    "campaign_outcomes", "stream_daily", "stream_status", "late_events", "stream_decisions",
    "answered_again",
}
PYTHON = {"page_text_html", "page_text_nested"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - WRITTEN))
def test_native_plans(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = any(word in text for word in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas"))
    assert python == (name in PYTHON)


def test_pages_are_parsed_a_few_at_a_time(spark, sf):
    """An Arrow batch holds up to 10,000 pages, however long they are; pickled ones come a hundred at a time."""
    for name in sorted(PYTHON):
        text = plan(entry.queries()[name](spark, sf))
        assert "BatchEvalPython" in text and "ArrowEvalPython" not in text


def test_a_day_is_looked_up_by_range_in_the_scan(spark, sf):
    log = spark.read.parquet(f"{sf}/events.parquet")
    text = plan(quota.sent_today(log, dt.date(2024, 1, 15), "CET"))
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts,2024-01-14T23:00)" in pushed and "LessThan(ts,2024-01-15T23:00)" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz>" in pushed


def test_a_day_of_the_log_is_one_or_two_folders(spark, sf):
    path = workspace.fresh(spark, "day-log")
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        logs.message_id("event_id").alias("message_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("run_id", "profile_url", "body", "status", "error_message")],
        "ts",
    )
    for _ in range(2):
        logs.append_messages(rows, path)
    log = logs.read_messages(spark, path)
    count = quota.sent_today(log, dt.date(2024, 1, 15), "CET")
    filters = plan(count).split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters and "2024-01-14" in filters and "2024-01-15" in filters
    assert count.first() == quota.sent_today(rows, dt.date(2024, 1, 15), "CET").first()
    assert log.count() == rows.count()


def test_a_dense_plan_needs_no_shuffle(spark, sf):
    text = plan(quota.plan_days(customer_contacts(spark, sf), 40, 5, dense=True))
    assert "Exchange" not in text and "Window" not in text


def test_a_window_never_spans_a_whole_run_of_rows(spark, sf):
    """The rows themselves are ordered leaf by leaf; only totals are ordered by run."""
    text = plan(quota.plan_days(customer_contacts(spark, sf), 40, 5))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 3
    assert sum("_leaf" in w and "profile_url" not in w.split("windowspec")[0] for w in windows) == 1
    assert all("_k" in w or "_leaf" in w for w in windows)


def test_window_and_join_share_one_shuffle_of_the_rows(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(quota.plan_days(customer_contacts(spark, sf), 40, 5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = text[text.index("SortMergeJoin") :].split("SortMergeJoin")[1]
    first_side = rows[: rows.index("FileScan")]
    assert first_side.count("Exchange hashpartitioning") == 1


def test_latest_rows_are_picked_before_the_shuffle(spark, sf):
    text = plan(history.latest_by_key(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], ["ts", "event_id"]))
    below = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in below


def test_decisions_form_no_pairs(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("key", F.lit("Enter"))
    text = plan(decisions.await_decision(events.select("event_id", "ts"), events, "event_id"))
    joins = [line for line in text.splitlines() if "Join " in line]
    assert len(joins) == 1 and "_leaf" in joins[0]


def test_only_hot_keys_are_told_to_all_tasks(spark, sf):
    """Whatever else is broadcast, Spark has measured; the hint is on the bounded list alone."""
    contacts = customer_contacts(spark, sf)
    on_file = contacts.select("profile_url", F.col("email").alias("on_file"))
    logical = resolve_address(contacts, on_file)._jdf.queryExecution().analyzed().toString()
    hints = logical.count("ResolvedHint (strategy=broadcast)")
    assert hints == 2 and logical.count("GlobalLimit 10000") == 2


def test_a_setting_is_a_scalar_subquery(spark, sf):
    contacts = customer_contacts(spark, sf)
    writes = spark.createDataFrame([], "key string, value string, ts timestamp_ntz, seq long")
    text = plan(quota.with_setting(contacts, quota.get_setting(writes)))
    assert "Subquery" in text and "Join" not in text
