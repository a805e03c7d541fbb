import datetime as dt

import pytest
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.operators import history as H
from postbag.operators.quota import get_setting, sent_today
from postbag.sources import logs as L


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.fixture
def paths(spark):
    return L.ensure_tables(spark, workspace.fresh(spark, "test-logs"))


def runs_log(spark, paths):
    return spark.read.schema(S.RUNS_LOG).parquet(paths["runs_log"])


def test_runs(spark, paths):
    L.start_run(spark, paths["runs_log"], "r1", "a.csv", ts("2024-01-01"))
    L.start_run(spark, paths["runs_log"], "r2", "b.csv", ts("2024-01-02"))
    L.end_run(spark, paths["runs_log"], "r2", S.FAILED, "x", ts("2024-01-02"), seq=1)
    L.end_run(spark, paths["runs_log"], "r2", S.COMPLETED, S.RUN_COMPLETED, ts("2024-01-02"), seq=2)
    assert L.ensure_tables(spark, paths["runs_log"].rsplit("/", 1)[0]) == paths
    assert runs_log(spark, paths).count() == 4
    current = H.newest_first(L.current_runs(runs_log(spark, paths)), "started", "run_id").collect()
    assert [(r.run_id, r.status, r.file_name, r.error_message) for r in current] == [
        ("r2", "Completed", "b.csv", S.RUN_COMPLETED),
        ("r1", "Running", "a.csv", None),
    ]


def test_settings(spark, paths):
    log = lambda: spark.read.schema(S.SETTINGS_LOG).parquet(paths["settings_log"])
    assert get_setting(log()).first().value == 100
    L.put_setting(spark, paths["settings_log"], "daily_limit", 25)
    assert get_setting(log()).first().value == 25
    L.put_setting(spark, paths["settings_log"], "daily_limit", 30)
    assert get_setting(log()).first().value == 30


def outcomes(spark, rows):
    made = spark.createDataFrame(rows, "run_id string, row_pos long, status string, t string")
    return made.select(
        L.message_id("run_id", "row_pos").alias("message_id"),
        "run_id",
        F.concat(F.lit("u"), "row_pos").alias("profile_url"),
        F.lit("text").alias("body"),
        "status",
        F.lit(None).cast("string").alias("error_message"),
        F.col("t").cast("timestamp_ntz").alias("ts"),
    )


def test_messages(spark, paths):
    assert L.read_messages(spark, paths["messages_log"]).count() == 0
    batch = outcomes(
        spark,
        [
            ("r1", 0, "Sent", "2024-01-15 23:59:59"),
            ("r1", 1, "Failed", "2024-01-16 00:00:00"),
            ("lost", 0, "Sent", "2024-01-16 10:00:00"),
        ],
    )
    for _ in range(2):
        L.append_messages(batch, paths["messages_log"])
    messages = L.read_messages(spark, paths["messages_log"])
    assert messages.count() == 3
    assert sent_today(messages, dt.date(2024, 1, 16)).first().sent == 2
    L.start_run(spark, paths["runs_log"], "r1", "a.csv")
    L.start_run(spark, paths["runs_log"], "r0", "b.csv")
    runs = L.current_runs(runs_log(spark, paths))
    seen = H.run_history(runs, messages).collect()
    assert sorted((r.run_id, r.run_status, r.profile_url, r.status) for r in seen if r.run_id == "r1") == [
        ("r1", "Running", "u0", "Sent"),
        ("r1", "Running", "u1", "Failed"),
    ]
    assert [(r.run_id, r.message_id) for r in seen if r.run_id == "r0"] == [("r0", None)] and len(seen) == 3
    assert [r.run_id for r in H.orphan_messages(messages, runs).collect()] == ["lost"]
    assert H.run_summary(messages).where("run_id = 'r1'").first().asDict() == {
        "run_id": "r1", "total": 2, "sent": 1, "skipped": 0, "failed": 1, "not_attempted": 0,
    }
    assert [r.profile_url for r in H.messages_of_run(messages, "r1").collect()] == ["u1", "u0"]
    assert "Join" not in runs._jdf.queryExecution().executedPlan().toString()
    one = H.message_detail(messages, messages.where("profile_url = 'u1'").first().message_id)
    assert [r.body for r in one.collect()] == ["text"]


def test_ids_tell_rows_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x"), ("", "x")], "p string, q string")
    assert rows.select(L.message_id("p", "q")).distinct().count() == 4


def test_views(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("a", t, 1), ("b", t, 2), ("a", t, 3), ("c", t + dt.timedelta(days=1), 4)], "run_id string, ts timestamp_ntz, n int"
    )
    assert sorted((r.run_id, r.n) for r in H.latest_by_key(df, ["run_id"], ["ts", "n"]).collect()) == [("a", 3), ("b", 2), ("c", 4)]
    assert [r.n for r in H.newest_first(df, "ts", "n").collect()] == [4, 3, 2, 1]
    assert H.first_row(df, F.col("n")).first().n == 1
    assert H.title_headers(df).columns == ["Run Id", "Ts", "N"]
    assert H.append_log(df, df.select("n", "ts", "run_id")).count() == 8
    assert H.where_equals(df, run_id="a", n=3).count() == 1


def test_outbox(spark):
    rows = spark.range(100).select(F.col("id").alias("row_pos"), (F.col("id") % 7).cast("int").alias("send_day"))
    path = workspace.fresh(spark, "test-outbox")
    L.write_outbox(rows, path)
    L.write_outbox(rows, path)
    assert L.read_outbox(spark, path).count() == 200
    L.write_outbox(rows, path, "overwrite")
    back = L.read_outbox(spark, path, ["send_day", "row_pos"]).where("send_day = 3")
    assert sorted(r.row_pos for r in back.collect()) == list(range(3, 100, 7))
