"""Streams over the driver's tables, each run over all the input there is and then read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import workspace
from postbag.operators.decisions import await_decision
from postbag.plans.decision_queries import (
    REVIEW_DAYS,
    SQL_MESSAGE_DECISIONS,
    line_decisions,
    order_drafts,
)
from postbag.plans.tables import SQL_DECISION, table
from postbag.streaming.operators import stream_daily_counts, stream_decisions
from postbag.streaming.sinks import (
    append_sink,
    read_upserts,
    run_to_end,
    stream_run_status,
    upsert_sink,
)
from postbag.streaming.sources import stream_table, with_event_time

#: Where the rows of the decision stream are cut into three goes, open at both ends.
CUTS = (None, "1997-03-01", "1999-05-01", None)
EPOCH = "1970-01-01"


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return stream_table(spark, f"{folder}/{name}.parquet", table(spark, folder, name).schema)


def stream_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Running counts, as a quota display needs them: the open day is in the table as well."""
    events = with_event_time(_stream(spark, folder, "events"), delay="1 hour")
    counts = stream_daily_counts(events)
    out = workspace.fresh(spark, "stream-daily")
    run_to_end(upsert_sink(counts, out, out + "-checkpoint"))
    return read_upserts(spark, out, counts.schema, ["day"])


def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    changes = _stream(spark, folder, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("status")
    )
    out = workspace.fresh(spark, "stream-status")
    run_to_end(stream_run_status(changes, out, out + "-checkpoint"))
    return read_upserts(spark, out, changes.schema, ["run_id"], ["seq"])


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    """Closed days when the errors arrive after everything else: those of closed days are too late."""
    events = table(spark, folder, "events").select("event_id", "ts", "event_type")
    inbox, out = workspace.fresh(spark, "inbox"), workspace.fresh(spark, "late")

    def arrive(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(inbox)
        stream = with_event_time(stream_table(spark, inbox, events.schema), delay="1 hour")
        run_to_end(append_sink(stream_daily_counts(stream), out, out + "-checkpoint"))

    arrive(events.where("event_type <> 'error'"))
    arrive(events.where("event_type = 'error'"))
    return spark.read.schema("day date, sent bigint").parquet(out)


def decisions_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their lines in three goes by time, each a restart of the stream, and a last one that ends it.

    The last go brings a row behind the newest window, so that every draft is decided or has timed out. Orders
    that a stream by event time cannot take, without a key or a time or from before its clock, are decided beside it.
    """
    orders, lines = order_drafts(table(spark, folder, "orders")), line_decisions(table(spark, folder, "lineitem"))
    drafts, presses, out = (workspace.fresh(spark, name) for name in ("drafts", "presses", "stream-decisions"))

    def arrive(new_drafts: DataFrame, new_presses: DataFrame) -> DataFrame:
        for rows, path in ((new_drafts, drafts), (new_presses, presses)):
            rows.write.mode("append").parquet(path)
        streams = [with_event_time(stream_table(spark, p, t.schema)) for t, p in ((orders, drafts), (lines, presses))]
        decided = stream_decisions(*streams, timeout_seconds=REVIEW_DAYS * 86_400)
        decided = decided.withColumns(
            {c: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz")) for c in ("drafted_at", "decided_at")}
        )
        run_to_end(append_sink(decided, out, out + "-checkpoint"))
        return spark.read.schema(decided.schema).parquet(out)

    for start, end in zip(CUTS, CUTS[1:]):
        since = F.col("ts").isNotNull() if start is None else F.col("ts") >= start
        until = F.lit(True) if end is None else F.col("ts") < end
        arrive(orders.where(since & until), lines.where(since & until))
    newest = orders.select("ts").unionByName(lines.select("ts")).agg(F.max("ts").alias("ts"))
    last = newest.select(
        F.lit(-1).cast(orders.schema["message_id"].dataType).alias("message_id"),
        (F.col("ts") + F.expr(f"INTERVAL {REVIEW_DAYS + 1} DAYS")).alias("ts"),
        F.lit("Enter").alias("key"),
    )
    decided = arrive(last.drop("key"), last)
    # Spark takes rows up to 1970 for late from the start.
    early = F.col("ts") <= EPOCH
    beside = orders.where(F.col("message_id").isNull() | F.col("ts").isNull() | early)
    beside = beside.groupBy("message_id").agg(F.min("ts").alias("ts"))
    near = lines.where(F.col("ts") <= F.lit(EPOCH).cast("timestamp_ntz") + F.expr(f"INTERVAL {REVIEW_DAYS} DAYS"))
    beside = await_decision(beside, near, timeout=REVIEW_DAYS * 86_400).withColumnRenamed("ts", "drafted_at")
    return decided.unionByName(beside.join(decided.select("message_id"), "message_id", "left_anti"))


QUERIES = {
    "stream_daily": stream_daily,
    "stream_status": stream_status,
    "late_events": late_events,
    "stream_decisions": decisions_stream,
}

SQL = {
    "stream_daily": "SELECT CAST(ts AS DATE) AS day, count(*) AS sent FROM events GROUP BY 1",
    "stream_status": """
      SELECT user_id AS run_id, event_id AS seq, ts, event_type AS status FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "late_events": """
      WITH m AS (SELECT date_trunc('millisecond', max(ts) FILTER (WHERE event_type <> 'error')) - INTERVAL 1 HOUR AS first_mark,
                        date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS last_mark FROM events),
      d AS (SELECT CAST(ts AS DATE) AS day, event_type, date_trunc('day', ts) + INTERVAL 1 DAY AS day_end FROM events)
      SELECT day, count(*) AS sent FROM d, m
      WHERE day_end <= last_mark AND (event_type <> 'error' OR day_end > first_mark) GROUP BY 1""",
    "stream_decisions": f"""{SQL_MESSAGE_DECISIONS}
      SELECT message_id, ts AS drafted_at, decided_at, pressed, {SQL_DECISION} AS decision FROM j WHERE nth = 1""",
}
