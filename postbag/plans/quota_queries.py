"""Counts, day plans, send windows and the outbox."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.functions.clock import next_window_start, seconds_until, send_after, to_zone
from postbag.operators.ordered import row_position, slice_rows
from postbag.operators.quota import (
    daily_counts,
    daily_room,
    get_setting,
    plan_by_room,
    plan_days,
    plan_shared,
    sent_today,
    with_setting,
)
from postbag.plans.contact_queries import SQL_CONTACTS, SQL_INFERRED, customer_contacts
from postbag.plans.outbox import schedule
from postbag.plans.tables import setting_writes, sql_micros, sql_setting, table
from postbag.sources.logs import (
    current_runs,
    ensure_tables,
    message_id,
    put_setting,
    read_outbox,
    write_outbox,
)

DAY = dt.date(2024, 1, 15)
NOW = "2024-01-15 03:30:00"


def sent_on_day(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumnRenamed("event_type", "status")

    def count(zone, statuses=None):
        return sent_today(events, DAY, zone, statuses)

    return (
        count("UTC").withColumn("counted", F.lit("UTC"))
        .unionByName(count("CET").withColumn("counted", F.lit("CET")))
        .unionByName(count("CET", ["click"]).withColumn("counted", F.lit("CET, clicks")))
    )


def counts_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return daily_counts(table(spark, folder, "events"), "CET")


def limit_setting(spark: SparkSession, folder: str) -> DataFrame:
    writes = setting_writes(spark, folder)
    names = ("purchase", "view", S.DAILY_LIMIT_KEY)
    parts = [get_setting(writes, n).withColumn("key", F.lit(n)) for n in names]
    texts = writes.withColumn("value", F.concat("value", F.lit(" per day")))
    parts.append(get_setting(texts, "click").withColumn("key", F.lit("click, not a number")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def day_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment's contacts under the limit last written, two already sent today."""
    limit = get_setting(setting_writes(spark, folder), "purchase")
    contacts = with_setting(customer_contacts(spark, folder), limit)
    return plan_days(contacts, F.col("daily_limit"), 2).select("run_id", "row_pos", "daily_limit", "send_day")


def day_plan_logged(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    planned = plan_days(
        events, 7, 3, F.col("event_type") != "error", run=["user_id"], position="event_id"
    )
    return planned.select("event_id", "user_id", "send_day")


def row_positions(spark: SparkSession, folder: str) -> DataFrame:
    return row_position(table(spark, folder, "events"), ["event_type"], "event_id").select(
        "event_type", "event_id", "row_pos"
    )


def row_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The eleventh to the thirtieth contact of each run."""
    contacts = customer_contacts(spark, folder).withColumnRenamed("row_pos", "custkey")
    return slice_rows(row_position(contacts, ["run_id"], "custkey"), 10, 20).select(
        "run_id", "custkey", "row_pos"
    )


def send_window(spark: SparkSession, folder: str) -> DataFrame:
    start = next_window_start(F.col("ts"))
    return table(spark, folder, "events").select(
        "event_id",
        to_zone(F.col("ts"), "CET").alias("local_ts"),
        start.alias("next_start"),
        seconds_until(F.col("ts"), start).alias("wait_seconds"),
        send_after(F.col("ts"), (F.col("user_id") % 3).cast("int")).alias("planned"),
    )


def outbox_by_day(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    planned = schedule(customer_contacts(spark, folder), now, 40, 5)
    outbox = planned.select(
        message_id("run_id", "row_pos").alias("message_id"),
        "run_id",
        "row_pos",
        "profile_url",
        "address",
        "address_is_inferred",
        F.concat(F.lit("To "), "profile_url").alias("subject"),
        F.concat(F.lit("Dear "), "first_name").alias("body"),
        F.lit("Email").alias("channel"),
        "send_day",
        "send_after",
    )
    path = workspace.fresh(spark, "outbox")
    write_outbox(outbox, path)
    return read_outbox(spark, path)


def campaign_days(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses, day plan, opening times, and what each day of each run holds."""
    now = F.lit(NOW).cast("timestamp_ntz")
    planned = schedule(customer_contacts(spark, folder), now, 40, 5)
    return planned.groupBy("run_id", "send_day", "send_after").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("address_is_inferred")).alias("inferred"),
        F.min("row_pos").alias("first_row"),
    )


def _segment_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run per market segment; names of equal length start at the same time."""
    segments = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("run_id")).distinct()
    started = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(hours=F.length("run_id"))
    log = segments.select("run_id", F.lit(0).alias("seq"), started.alias("ts"), F.lit(S.RUNNING).alias("status"))
    return current_runs(log.withColumn("file_name", F.col("run_id")))


def _in_threes(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Contacts of which three share each position."""
    contacts = customer_contacts(spark, folder, *keep)
    return contacts.withColumn("row_pos", F.floor(F.col("row_pos") / 3))


def shared_plan(spark: SparkSession, folder: str) -> DataFrame:
    """All runs under one limit; contacts in debt, who have an address on file, use no quota."""
    limit = get_setting(setting_writes(spark, folder), "purchase")
    contacts = with_setting(_in_threes(spark, folder), limit)
    runs, no_address = _segment_runs(spark, folder), F.col("email").isNull()
    room = F.col("daily_limit")
    planned = plan_shared(contacts, runs, room, 2, no_address, tie=["profile_url"])
    everyone = plan_shared(contacts, runs, room, 2, tie=["profile_url"], out="day_if_all")
    return planned.select("run_id", "row_pos", "profile_url", "daily_limit", "send_day").join(
        everyone.select("profile_url", "day_if_all"), "profile_url"
    )


#: When which limit was written: one for today, none from the third day on, a lower one from the fourth.
LIMITS = (("200", "2024-01-14 09:00:00"), ("0", "2024-01-17 10:00:00"), ("90", "2024-01-18 12:00:00"))


def plan_by_settings(spark: SparkSession, folder: str) -> DataFrame:
    """All runs under a limit that changes twice, beside errors that are logged on the same days."""
    settings = ensure_tables(spark, workspace.fresh(spark, "settings"))["settings_log"]
    for seq, (value, ts) in enumerate(LIMITS):
        put_setting(spark, settings, S.DAILY_LIMIT_KEY, value, F.lit(ts).cast("timestamp_ntz"), seq)
    setting_writes(spark, folder).write.mode("append").parquet(settings)
    sent = daily_counts(table(spark, folder, "events").where("event_type = 'error'"), "CET")
    now = F.lit(NOW).cast("timestamp_ntz")
    room = daily_room(spark.read.schema(S.SETTINGS_LOG).parquet(settings), now, sent)
    planned = plan_by_room(_in_threes(spark, folder), _segment_runs(spark, folder), room, tie=["profile_url"])
    return planned.select(
        "run_id", "row_pos", "profile_url", "send_day", send_after(now, F.col("send_day")).alias("send_after")
    )


QUERIES = {
    "shared_plan": shared_plan,
    "plan_by_settings": plan_by_settings,
    "campaign_days": campaign_days,
    "sent_on_day": sent_on_day,
    "daily_counts": counts_by_day,
    "limit_setting": limit_setting,
    "day_plan": day_plan,
    "day_plan_logged": day_plan_logged,
    "row_positions": row_positions,
    "row_slice": row_slice,
    "send_window": send_window,
    "outbox_by_day": outbox_by_day,
}


def _cet(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'CET')"


def _utc(local: str) -> str:
    return f"(({local} AT TIME ZONE 'CET') AT TIME ZONE 'UTC')"


def send_after_sql(ts: str, day: str) -> str:
    local = f"(date_trunc('day', {_cet(ts)}) + to_days(CAST({day} AS INTEGER)) + INTERVAL 5 HOUR)"
    return f"CASE WHEN {day} = 0 THEN {ts} ELSE {_utc(local)} END"


_NEXT = _utc(
    f"(date_trunc('day', {_cet('ts')}) + CASE WHEN hour({_cet('ts')}) >= 5 THEN INTERVAL 29 HOUR ELSE INTERVAL 5 HOUR END)"
)

_PLANNED = f"""
  WITH contacts AS ({SQL_CONTACTS}),
  planned AS (
    SELECT *, coalesce(email, {SQL_INFERRED}) AS address, email IS NULL AS address_is_inferred,
      CAST((5 + row_number() OVER (PARTITION BY run_id ORDER BY row_pos) - 1) // 40 AS INTEGER) AS send_day
    FROM contacts),
  timed AS (SELECT *, {send_after_sql(f"TIMESTAMP '{NOW}'", 'send_day')} AS send_after FROM planned)"""

_THREES = f"""
  WITH contacts AS (SELECT * REPLACE (row_pos // 3 AS row_pos) FROM ({SQL_CONTACTS})),
  ordered_rows AS (SELECT *, TIMESTAMP '{NOW}' - to_hours(length(run_id)) AS started FROM contacts)"""

_ORDER = "OVER (ORDER BY started, run_id, row_pos, profile_url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

SQL = {
    "shared_plan": f"""{_THREES},
      lim AS (SELECT {sql_setting('purchase', S.DEFAULT_DAILY_LIMIT)} AS daily_limit)
      SELECT run_id, row_pos, profile_url, daily_limit,
             CAST((least(2, daily_limit) + coalesce(sum(CASE WHEN email IS NULL THEN 1 ELSE 0 END) {_ORDER}, 0))
                  // daily_limit AS INTEGER) AS send_day,
             CAST((least(2, daily_limit) + count(*) {_ORDER}) // daily_limit AS INTEGER) AS day_if_all
      FROM ordered_rows, lim""",
    "plan_by_settings": f"""{_THREES},
      placed AS (SELECT *, count(*) {_ORDER} AS ahead FROM ordered_rows),
      sent AS (SELECT CAST({_cet('ts')} AS DATE) - DATE '{DAY}' AS day_no, count(*) AS sent FROM events
               WHERE event_type = 'error' GROUP BY 1),
      days AS (SELECT day_no, greatest(CASE WHEN day_no < 3 THEN 200 WHEN day_no = 3 THEN 0 ELSE 90 END - coalesce(sent, 0), 0) AS room
               FROM (SELECT unnest(range(3000)) AS day_no) LEFT JOIN sent USING (day_no)),
      filled AS (SELECT day_no, sum(room) OVER (ORDER BY day_no) AS until FROM days),
      planned AS (SELECT run_id, row_pos, profile_url, CAST(min(day_no) AS INTEGER) AS send_day
                  FROM placed JOIN filled ON until > ahead GROUP BY ALL)
      SELECT *, {send_after_sql(f"TIMESTAMP '{NOW}'", 'send_day')} AS send_after FROM planned""",
    "campaign_days": f"""{_PLANNED}
      SELECT run_id, send_day, send_after, count(*) AS messages,
             count(*) FILTER (WHERE address_is_inferred) AS inferred, min(row_pos) AS first_row
      FROM timed GROUP BY ALL""",
    "sent_on_day": f"""
      SELECT 'UTC' AS counted, count(*) AS sent FROM events WHERE CAST(ts AS DATE) = DATE '{DAY}'
      UNION ALL SELECT 'CET', count(*) FROM events WHERE CAST({_cet('ts')} AS DATE) = DATE '{DAY}'
      UNION ALL SELECT 'CET, clicks', count(*) FROM events
      WHERE CAST({_cet('ts')} AS DATE) = DATE '{DAY}' AND event_type = 'click'""",
    "daily_counts": f"SELECT CAST({_cet('ts')} AS DATE) AS day, count(*) AS sent FROM events GROUP BY 1",
    "limit_setting": f"""
      SELECT 'purchase' AS key, {sql_setting('purchase', S.DEFAULT_DAILY_LIMIT)} AS value
      UNION ALL SELECT 'view', {sql_setting('view', S.DEFAULT_DAILY_LIMIT)}
      UNION ALL SELECT '{S.DAILY_LIMIT_KEY}', {sql_setting(S.DAILY_LIMIT_KEY, S.DEFAULT_DAILY_LIMIT)}
      UNION ALL SELECT 'click, not a number', {S.DEFAULT_DAILY_LIMIT}""",
    "day_plan": f"""
      WITH lim AS (SELECT {sql_setting('purchase', S.DEFAULT_DAILY_LIMIT)} AS daily_limit)
      SELECT c_mktsegment AS run_id, c_custkey AS row_pos, daily_limit,
             CAST((least(2, daily_limit) + row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1)
                  // daily_limit AS INTEGER) AS send_day
      FROM customer, lim""",
    "day_plan_logged": """
      SELECT event_id, user_id, CAST((3 + coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) // 7
        AS INTEGER) AS send_day FROM events""",
    "row_positions": """
      SELECT event_type, event_id,
             row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_pos FROM events""",
    "row_slice": """
      SELECT * FROM (SELECT c_mktsegment AS run_id, c_custkey AS custkey,
             row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS row_pos FROM customer)
      WHERE row_pos >= 10 AND row_pos < 30""",
    "send_window": f"""
      SELECT event_id, {_cet('ts')} AS local_ts, {_NEXT} AS next_start,
             ({sql_micros(_NEXT)} - {sql_micros('ts')}) / CAST(1000000 AS DOUBLE) AS wait_seconds,
             {send_after_sql('ts', '(user_id % 3)')} AS planned
      FROM events""",
    "outbox_by_day": f"""{_PLANNED}
      SELECT sha256(run_id || chr(31) || row_pos) AS message_id, run_id, row_pos, profile_url, address,
             address_is_inferred, 'To ' || profile_url AS subject, 'Dear ' || first_name AS body,
             'Email' AS channel, send_day, send_after
      FROM timed""",
}
