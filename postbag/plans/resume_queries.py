"""A campaign that breaks off in the middle and is taken up again from its logs."""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.operators.quota import get_setting, sent_today, with_setting
from postbag.plans.contact_queries import SQL_CONTACTS, customer_contacts
from postbag.plans.outbox import log_run_states, reviewed_outcomes, run_states, schedule, unfinished
from postbag.plans.quota_queries import NOW, send_after_sql
from postbag.plans.tables import SQL_EVENT_KEY, event_key, table
from postbag.sources.logs import (
    append_messages,
    current_runs,
    end_run,
    ensure_tables,
    message_id,
    put_setting,
    read_messages,
    start_run,
)

AGAIN = "2024-01-16 06:00:00"
LIMIT, REVIEW = 300, 86_400
RUNS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # fixed values: the segments there are


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def resumed_run(spark: SparkSession, folder: str) -> DataFrame:
    """All segments as runs under one limit; the first attempt breaks off on its second day.

    Its batch is logged twice, at first with times of the next day, as by a task that was run again. The
    second attempt finds who is left, plans them behind what was logged that day and ends the runs.
    """
    paths = ensure_tables(spark, workspace.fresh(spark, "resumed"))
    put_setting(spark, paths["settings_log"], S.DAILY_LIMIT_KEY, LIMIT, _at(NOW))
    for k, run in enumerate(RUNS):
        start_run(spark, paths["runs_log"], run, folder, _at(NOW) - F.make_dt_interval(hours=F.lit(k % 3)))
    limit = get_setting(spark.read.schema(S.SETTINGS_LOG).parquet(paths["settings_log"]))
    runs = current_runs(spark.read.schema(S.RUNS_LOG).parquet(paths["runs_log"]))
    contacts = customer_contacts(spark, folder, "c_nationkey")
    presses = table(spark, folder, "events").where("event_type <> 'view'").select(
        F.col("user_id").alias("row_pos"), "ts", event_key().alias("key"), "event_id"
    )

    def results(todo: DataFrame, at: Column, sent: int | Column) -> DataFrame:
        planned = schedule(with_setting(todo, limit), at, F.col("daily_limit"), sent, runs=runs)
        drafts = planned.select(
            "*",
            F.col("send_after").alias("ts"),
            F.concat(F.lit("Dear "), "last_name").alias("body"),
            F.when(F.col("c_nationkey") % 7 > 0, F.col("profile_url")).alias("profile_id"),
            F.when(F.col("address").isNull(), "No address could be inferred.").alias("error"),
        )
        return reviewed_outcomes(drafts, presses, "row_pos", "event_id", REVIEW, keep=["row_pos", "send_day"])

    first = workspace.keep(results(contacts, _at(NOW), 2), "first-attempt")
    done = first.where((F.col("send_day") == 0) | ((F.col("send_day") == 1) & (F.col("row_pos") % 3 > 0)))
    for delay in (1, 0):
        append_messages(done.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(delay))), paths["messages_log"], "first")
    log = read_messages(spark, paths["messages_log"])
    broken = run_states(contacts, log, F.lit(True), interrupted=F.lit(True))
    log_run_states(broken, paths["runs_log"], _at(AGAIN), 1)

    sent = sent_today(log, dt.date.fromisoformat(AGAIN[:10]), S.SEND_ZONE).first().sent
    second = workspace.keep(results(unfinished(contacts, log), _at(AGAIN), sent), "second-attempt")
    append_messages(second, paths["messages_log"], "second")
    log = read_messages(spark, paths["messages_log"])
    log_run_states(run_states(contacts, log, F.lit(True)), paths["runs_log"], _at(AGAIN), 2)
    end_run(spark, paths["runs_log"], "none", S.FAILED, S.RUN_ENDED, _at(AGAIN))
    states = current_runs(spark.read.schema(S.RUNS_LOG).parquet(paths["runs_log"]))
    states = states.select("run_id", F.col("status").alias("run_status"), F.col("error_message").alias("run_message"))
    days = done.select("message_id", F.lit(1).alias("attempt"), "send_day", "row_pos").unionByName(
        second.select("message_id", F.lit(2).alias("attempt"), "send_day", "row_pos")
    )
    outcome = log.select("message_id", "run_id", "profile_url", "status", "error_message", "ts")
    return outcome.join(days, "message_id").join(F.broadcast(states), "run_id")


QUERIES = {"resumed_run": resumed_run}

_STARTED = " ".join(f"WHEN '{run}' THEN {k % 3}" for k, run in enumerate(RUNS))
_ORDER = "OVER (ORDER BY started, run_id, row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

SQL = {
    "resumed_run": f"""
      WITH c AS (SELECT f.*, c_nationkey, TIMESTAMP '{NOW}' - to_hours(CASE run_id {_STARTED} END) AS started
                 FROM ({SQL_CONTACTS}) f JOIN customer ON c_name = profile_url),
      p1 AS (SELECT *, CAST((2 + count(*) {_ORDER}) // {LIMIT} AS INTEGER) AS send_day FROM c),
      a1 AS (SELECT *, 1 AS attempt, {send_after_sql(f"TIMESTAMP '{NOW}'", 'send_day')} AS ts FROM p1
             WHERE send_day = 0 OR (send_day = 1 AND row_pos % 3 > 0)),
      n1 AS (SELECT least({LIMIT}, count(*) FILTER (WHERE send_day = 1)) AS sent FROM a1),
      p2 AS (SELECT c.*, CAST(((SELECT sent FROM n1) + count(*) {_ORDER}) // {LIMIT} AS INTEGER) AS send_day
             FROM c WHERE row_pos NOT IN (SELECT row_pos FROM a1)),
      a2 AS (SELECT *, 2 AS attempt, {send_after_sql(f"TIMESTAMP '{AGAIN}'", 'send_day')} AS ts FROM p2),
      a AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2),
      e AS (SELECT user_id, ts AS hit_at, event_id, {SQL_EVENT_KEY} AS key FROM events WHERE event_type <> 'view'),
      d AS (SELECT a.*, e.key AS pressed, row_number() OVER (PARTITION BY row_pos ORDER BY hit_at, event_id) AS nth
            FROM a LEFT JOIN e ON user_id = row_pos AND key <> 'a' AND hit_at > ts AND hit_at <= ts + INTERVAL {REVIEW} SECOND)
      SELECT sha256(run_id || chr(31) || row_pos) AS message_id, run_id, row_pos, profile_url, attempt, send_day, ts,
             CASE WHEN c_nationkey % 7 > 0 AND pressed = 'Enter' THEN '{S.READY}'
                  WHEN c_nationkey % 7 > 0 AND pressed = 'Backspace' THEN '{S.SKIPPED}' ELSE '{S.FAILED}' END AS status,
             CASE WHEN c_nationkey % 7 = 0 THEN '{S.NO_PROFILE_ID}' WHEN pressed = 'Enter' THEN NULL
                  WHEN pressed = 'Backspace' THEN '{S.USER_SKIPPED}' WHEN pressed IS NULL THEN '{S.REVIEW_TIMEOUT}'
                  ELSE '{S.UNRECOGNIZED_KEY}' END AS error_message,
             '{S.COMPLETED}' AS run_status, '{S.RUN_COMPLETED}' AS run_message
      FROM d WHERE nth = 1"""
}
