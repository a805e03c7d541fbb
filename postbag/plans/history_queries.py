"""Run log, message log and their views."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.functions.text import preview, profile_link, title_text
from postbag.operators.history import (
    append_log,
    first_row,
    latest_by_key,
    message_detail,
    newest_first,
    orphan_messages,
    run_history,
    run_summary,
    title_headers,
    where_equals,
)
from postbag.operators.outcomes import classify_message, classify_run, unfinished_runs
from postbag.operators.quota import row_count
from postbag.plans.tables import (
    SQL_EVENT_KEY,
    SQL_EVENT_NUMBER,
    event_key,
    event_number,
    sql_text,
    table,
)
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

# Event kinds standing in for message states.
STATES = {
    "click": S.SENT,
    "view": S.SENT,
    "purchase": S.SKIPPED,
    "error": S.FAILED,
    "signup": S.NOT_ATTEMPTED,
}


def _state():
    chain = F
    for kind, status in STATES.items():
        chain = chain.when(F.col("event_type") == kind, status)
    return chain


SQL_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"


def latest_status(spark: SparkSession, folder: str) -> DataFrame:
    latest = latest_by_key(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"])
    return latest.select("user_id", "event_id", "event_type", "ts")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts")
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_returnflag").alias("status"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    both = run_history(_runs(spark, folder), _lines(spark, folder), ["part", "line"])
    return both.select("run_id", "run_status", "run_ts", "part", "line", "ts", "status")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of orders that are not in a run log of the open and partly shipped ones."""
    runs = _runs(spark, folder).where(F.col("status") != "F")
    return orphan_messages(_lines(spark, folder), runs, ["part", "line"])


def summary(spark: SparkSession, folder: str) -> DataFrame:
    messages = table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), _state().alias("status"), "ts"
    )
    runs = run_summary(messages)
    attempted = F.col("total") - F.col("not_attempted")
    state = classify_run(
        F.col("total"),
        attempted,
        ended=F.col("sent") > 2 * F.col("skipped"),
        rejected=F.when(F.col("sent") == 0, S.MISSING_COLUMNS),
        startup_error=F.when(F.col("skipped") == 0, F.lit("no driver")),
        interrupted=F.col("failed") > F.col("sent"),
        unexpected_error=F.when(F.col("not_attempted") > F.col("sent"), F.lit("lost")),
    )
    return runs.withColumn("state", state).select("*", "state.*").drop("state")


def newest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of the run list."""
    return newest_first(_runs(spark, folder), "ts", "run_id").limit(100)


def oldest_run(spark: SparkSession, folder: str) -> DataFrame:
    return first_row(_runs(spark, folder), F.col("ts"), F.col("run_id"))


def open_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Open orders as runs never ended, seen at the start of 2000."""
    runs = _runs(spark, folder).withColumn(
        "status", F.when(F.col("status") == "O", S.RUNNING).otherwise(S.COMPLETED)
    )
    return unfinished_runs(runs, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))


def message_outcome(spark: SparkSession, folder: str) -> DataFrame:
    number = event_number()
    verdict = classify_message(
        error=F.when(F.col("event_type") == "error", F.concat(F.lit("Element missing: "), "props")),
        profile_id=F.when(number >= 10, F.concat(F.lit("P"), F.col("user_id"))),
        no_recipient=number < 20,
        review=F.col("event_type") != "view",
        pressed=F.when(number < 80, event_key()),
        send_disabled=number > 90,
        attempted=F.col("value") >= 1,
    )
    return (
        table(spark, folder, "events")
        .select("event_id", verdict.alias("verdict"))
        .select("event_id", "verdict.*")
    )


def message_views(spark: SparkSession, folder: str) -> DataFrame:
    """German texts as the history page shows them."""
    shown = where_equals(table(spark, folder, "documents"), lang="de").select(
        F.col("doc_id").alias("message_id"),
        profile_link(F.concat_ws("-", "lang", "doc_id")).alias("profile_link"),
        preview(F.col("text")).alias("message_preview"),
        title_text(F.concat_ws("_", "lang", "source")).alias("source_title"),
    )
    return title_headers(shown)


def flagged_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Full text of the messages a reader has flagged."""
    messages = table(spark, folder, "documents").select(F.col("doc_id").alias("message_id"), F.col("text").alias("body"))
    flagged = table(spark, folder, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("message_id"))
    return message_detail(messages, flagged)


def log_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches of outcomes appended to a new log, the second one twice, as after a failed run."""
    paths = ensure_tables(spark, workspace.fresh(spark, "logs"))
    start_run(spark, paths["runs_log"], "events", folder)
    put_setting(spark, paths["settings_log"], S.DAILY_LIMIT_KEY, S.DEFAULT_DAILY_LIMIT)
    outcomes = table(spark, folder, "events").select(
        message_id("event_id").alias("message_id"),
        F.lit("events").alias("run_id"),
        F.col("user_id").cast("string").alias("profile_url"),
        F.col("props").alias("body"),
        _state().alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        "ts",
    )
    append_messages(outcomes.where(F.col("status") == S.SENT), paths["messages_log"])
    for _ in range(2):
        append_messages(outcomes.where(F.col("status") != S.SENT), paths["messages_log"])
    end_run(spark, paths["runs_log"], "events", S.COMPLETED, S.RUN_COMPLETED)
    log = read_messages(spark, paths["messages_log"])
    run = current_runs(spark.read.schema(S.RUNS_LOG).parquet(paths["runs_log"]))
    counts = log.groupBy("run_id", F.col("status").alias("counted")).agg(F.count("*").alias("n"))
    total = row_count(log).select(F.lit("events").alias("run_id"), F.lit("all").alias("counted"), F.col("rows").alias("n"))
    return append_log(counts, total).join(run.select("run_id", "status", "error_message"), "run_id")


QUERIES = {
    "latest_status": latest_status,
    "run_history": history,
    "orphans": orphans,
    "run_summary": summary,
    "newest_runs": newest_runs,
    "oldest_run": oldest_run,
    "open_runs": open_runs,
    "message_outcome": message_outcome,
    "message_views": message_views,
    "flagged_messages": flagged_messages,
    "log_append": log_append,
}

SQL_RUNS = "SELECT o_orderkey AS run_id, o_orderstatus AS status, o_orderdate AS ts FROM orders"

SQL = {
    "latest_status": """
      SELECT user_id, event_id, event_type, ts FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "run_history": """
      SELECT o_orderkey AS run_id, o_orderstatus AS run_status, o_orderdate AS run_ts, l_partkey AS part,
             l_linenumber AS line, l_shipdate AS ts, l_returnflag AS status
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
    "orphans": """
      SELECT l_orderkey AS run_id, l_partkey AS part, l_linenumber AS line, l_shipdate AS ts, l_returnflag AS status
      FROM lineitem
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')""",
    "run_summary": f"""
      WITH m AS (SELECT user_id AS run_id, {SQL_STATE} AS status FROM events),
      r AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = '{S.SENT}') AS sent,
                   count(*) FILTER (WHERE status = '{S.SKIPPED}') AS skipped,
                   count(*) FILTER (WHERE status = '{S.FAILED}') AS failed,
                   count(*) FILTER (WHERE status = '{S.NOT_ATTEMPTED}') AS not_attempted
            FROM m GROUP BY run_id),
      c AS (SELECT *, CASE WHEN sent = 0 THEN 1 WHEN skipped = 0 THEN 2 WHEN failed > sent THEN 3
                           WHEN not_attempted > sent THEN 4 WHEN not_attempted = 0 THEN 5
                           WHEN sent > 2 * skipped THEN 6 ELSE 7 END AS rule FROM r)
      SELECT run_id, total, sent, skipped, failed, not_attempted,
             CASE rule WHEN 1 THEN '{S.ERROR}' WHEN 3 THEN '{S.INTERRUPTED}' WHEN 5 THEN '{S.COMPLETED}'
                       WHEN 7 THEN '{S.RUNNING}' ELSE '{S.FAILED}' END AS status,
             CASE rule WHEN 1 THEN '{S.MISSING_COLUMNS}' WHEN 2 THEN '{S.RUN_STARTUP_PREFIX}no driver'
                       WHEN 3 THEN '{S.RUN_INTERRUPTED}' WHEN 4 THEN '{S.RUN_UNEXPECTED_PREFIX}lost'
                       WHEN 5 THEN '{S.RUN_COMPLETED}' WHEN 6 THEN '{S.RUN_ENDED}' END AS error_message
      FROM c""",
    "newest_runs": f"{SQL_RUNS} ORDER BY ts DESC, run_id DESC LIMIT 100",
    "oldest_run": f"{SQL_RUNS} ORDER BY ts, run_id LIMIT 1",
    "open_runs": f"""
      SELECT run_id, '{S.RUNNING}' AS status, ts,
             (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(ts)) / CAST(1000000 AS DOUBLE) AS open_seconds
      FROM ({SQL_RUNS}) WHERE status = 'O' AND ts <= TIMESTAMP '2000-01-01'""",
    "message_outcome": f"""
      WITH e AS (SELECT *, {SQL_EVENT_NUMBER} AS k, {SQL_EVENT_KEY} AS pressed_key FROM events),
      c AS (SELECT *, CASE WHEN value < 1 THEN 0 WHEN event_type = 'error' THEN 1 WHEN k < 10 THEN 2 WHEN k < 20 THEN 3
              WHEN event_type <> 'view' AND k < 80 AND pressed_key = 'Backspace' THEN 4
              WHEN event_type <> 'view' AND k < 80 AND pressed_key <> 'Enter' THEN 5
              WHEN event_type <> 'view' AND k >= 80 THEN 6
              WHEN k > 90 THEN 7 ELSE 8 END AS rule FROM e)
      SELECT event_id,
        CASE WHEN rule = 0 THEN '{S.NOT_ATTEMPTED}' WHEN rule = 3 THEN NULL WHEN rule = 4 THEN '{S.SKIPPED}'
             WHEN rule = 8 THEN '{S.READY}' ELSE '{S.FAILED}' END AS status,
        CASE rule WHEN 1 THEN 'Element missing: ' || props WHEN 2 THEN '{S.NO_PROFILE_ID}' WHEN 4 THEN '{S.USER_SKIPPED}'
             WHEN 5 THEN '{S.UNRECOGNIZED_KEY}' WHEN 6 THEN '{S.REVIEW_TIMEOUT}' WHEN 7 THEN '{S.SEND_DISABLED}'
        END AS error_message,
        rule NOT IN (0, 3) AS is_logged
      FROM c""",
    "message_views": f"""
      SELECT doc_id AS "Message Id", {sql_text(S.PROFILE_LINK_PREFIX)} || lang || '-' || doc_id AS "Profile Link",
             substr(text, 1, {S.PREVIEW_CHARS}) || '...' AS "Message Preview",
             upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || lower(source[2:]) AS "Source Title"
      FROM documents WHERE lang = 'de'""",
    "flagged_messages": """
      SELECT doc_id AS message_id, text AS body FROM documents
      WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1)""",
    "log_append": f"""
      WITH m AS (SELECT {SQL_STATE} AS counted FROM events),
      n AS (SELECT counted, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM m)
      SELECT 'events' AS run_id, counted, n, '{S.COMPLETED}' AS status, '{S.RUN_COMPLETED}' AS error_message FROM n""",
}
