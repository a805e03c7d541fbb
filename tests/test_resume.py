"""Runs that break off, logs that are written again, and an outbox of any length."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.operators.quota import daily_counts, sent_today
from postbag.plans import outbox as O
from postbag.sources import logs as L


def batch(spark, ids, day):
    cells = [(f"m{i}", "r", "u", "b", S.SENT, None, dt.datetime(2024, 1, day, 23, i % 60)) for i in ids]
    return spark.createDataFrame(cells, S.MESSAGES_LOG)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_counts_once_whenever_it_is_logged_again(spark):
    path = L.ensure_tables(spark, workspace.fresh(spark, "log"))["messages_log"]
    L.append_messages(batch(spark, range(50), 1), path, "a")
    L.append_messages(batch(spark, range(50, 60), 1), path, "b")
    L.append_messages(batch(spark, range(50), 2), path, "a")
    log = L.read_messages(spark, path)
    assert {r.day.day: r.sent for r in daily_counts(log).collect()} == {1: 10, 2: 50}
    assert log.count() == log.select("message_id").distinct().count() == 60
    # without a name, a batch is known by its ids, in whatever order they come
    for day, ids in ((3, range(60, 70)), (4, reversed(range(60, 70)))):
        L.append_messages(batch(spark, ids, day), path)
    assert sent_today(L.read_messages(spark, path), dt.date(2024, 1, 4)).first().sent == 10
    assert L.read_messages(spark, path).count() == 70


def test_reading_the_log_is_a_scan(spark):
    path = L.ensure_tables(spark, workspace.fresh(spark, "log"))["messages_log"]
    assert L.read_messages(spark, path).count() == 0
    L.append_messages(batch(spark, range(5), 1), path, "a")
    text = plan(L.read_messages(spark, path))
    assert "Window" not in text and "Exchange" not in text and "Sort" not in text
    filters = plan(sent_today(L.read_messages(spark, path), dt.date(2024, 1, 1))).split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters


def folders(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [str(s.getPath().getName()) for s in system.listStatus(place) if s.isDirectory()]


def test_an_outbox_has_a_folder_a_month(spark):
    start = F.lit("2024-01-15 05:00:00").cast("timestamp_ntz")
    rows = spark.range(4000).select("id", (F.col("id") % 200).cast("int").alias("send_day"))
    rows = rows.withColumn("send_after", start + F.make_dt_interval(days=F.col("send_day")))
    path = workspace.fresh(spark, "outbox")
    L.write_outbox(rows, path)
    assert len(folders(spark, path)) == 8
    assert L.read_outbox(spark, path).exceptAll(rows.select("id", "send_day", "send_after")).count() == 0
    one = L.read_outbox(spark, path, month="2024-02")
    assert one.select("send_day").distinct().count() == 29
    assert "send_month" in plan(one).split("PartitionFilters: [")[1].split("]")[0]
    day = L.read_outbox(spark, path).where("send_day = 77")
    assert "EqualTo(send_day,77)" in plan(day) and day.count() == 20
    plain = workspace.fresh(spark, "outbox")
    L.write_outbox(rows.drop("send_after"), plain)
    assert len(folders(spark, plain)) == 7


def test_rows_of_an_outbox_lie_in_order_of_their_days(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 10).cast("int").alias("send_day"))
    path = workspace.fresh(spark, "outbox")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        L.write_outbox(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("send_day"), F.max("send_day"), F.count("*"))
    spans = sorted((r[1], r[2]) for r in ranges.collect())
    assert len(spans) > 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


@pytest.fixture(scope="module")
def contacts(spark):
    return spark.range(100).selectExpr("if(id % 4 = 0, 'a', 'b') run_id", "id row_pos", "concat('u', id) profile_url")


def test_what_is_left_of_a_run(spark, contacts):
    ids = contacts.where("row_pos % 3 = 1").select(L.message_id("run_id", "row_pos").alias("message_id"))
    left = O.unfinished(contacts, ids)
    assert left.columns == contacts.columns
    assert {r.row_pos for r in left.collect()} == {i for i in range(100) if i % 3 != 1}
    assert O.unfinished(contacts, ids.where("false")).count() == 100
    assert O.unfinished(contacts, contacts.select(L.message_id("run_id", "row_pos").alias("message_id"))).count() == 0


def test_states_of_runs(spark, contacts):
    log = contacts.where("run_id = 'a' OR row_pos < 50")
    yes, no = F.lit(True), F.lit(False)

    def states(*args, **more):
        return {r.run_id: (r.attempted, r.status) for r in O.run_states(contacts, log, *args, **more).collect()}

    a, b = log.where("run_id = 'a'").count(), log.where("run_id = 'b'").count()
    assert states(no) == {"a": (a, S.COMPLETED), "b": (b, S.RUNNING)}
    assert states(yes) == {"a": (a, S.COMPLETED), "b": (b, S.FAILED)}
    assert states(yes, interrupted=yes)["b"] == (b, S.INTERRUPTED)
    assert O.run_states(contacts, log.where("false"), no).where("attempted = 0").count() == 2


def test_reviews_decide_outcomes(spark):
    ts = dt.datetime(2024, 1, 15, 10)
    drafts = spark.createDataFrame(
        [("r", i, f"u{i}", "b", None, f"p{i}", ts) for i in range(4)],
        "run_id string, row_pos long, profile_url string, body string, error string, profile_id string, ts timestamp_ntz",
    )
    keys = ["Enter", "Backspace", "Shift"]
    presses = spark.createDataFrame(
        [(i, ts + dt.timedelta(seconds=i + 1), k) for i, k in enumerate(keys)] + [(0, ts + dt.timedelta(seconds=9), "Backspace")],
        "row_pos long, ts timestamp_ntz, key string",
    )
    got = O.reviewed_outcomes(drafts, presses, "row_pos", keep=["row_pos"]).collect()
    assert Counter((r.row_pos, r.status, r.error_message) for r in got) == Counter(
        [(0, S.READY, None), (1, S.SKIPPED, S.USER_SKIPPED), (2, S.FAILED, S.UNRECOGNIZED_KEY), (3, S.FAILED, S.REVIEW_TIMEOUT)]
    )
