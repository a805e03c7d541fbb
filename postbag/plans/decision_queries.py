"""Key logs and review decisions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.operators.decisions import await_decision, parse_key_log
from postbag.plans.tables import SQL_DECISION, SQL_EVENT_KEY, event_key, table

REVIEW_DAYS = 30


def _views(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").where("event_type = 'view'").select("event_id", "user_id", "ts")


def _presses(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .where("event_type <> 'view'")
        .select("user_id", "ts", event_key().alias("key"), F.col("event_id").alias("press_id"))
    )


def _decided(spark: SparkSession, folder: str, seconds: int) -> DataFrame:
    return await_decision(
        _views(spark, folder), _presses(spark, folder), "user_id", "press_id", timeout=seconds
    )


def decision_join(spark: SparkSession, folder: str) -> DataFrame:
    """Views as drafts, the same user's next answer within five minutes as the decision."""
    return _decided(spark, folder, 300)


def decision_join_day(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(spark, folder, 86_400)


def order_drafts(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderdate").alias("ts"))


def line_decisions(lines: DataFrame) -> DataFrame:
    """Shipped lines as keys pressed for their order; those still open are typing."""
    key = (
        F.when(F.col("l_linestatus") == "O", "a")
        .when(F.col("l_returnflag") == "A", "Enter")
        .when(F.col("l_returnflag") == "R", "Backspace")
        .otherwise("Shift")
    )
    return lines.select(
        F.col("l_orderkey").alias("message_id"), F.col("l_shipdate").alias("ts"), key.alias("key")
    )


def message_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as drafts, each with the first answer of its own lines within thirty days."""
    return await_decision(
        order_drafts(table(spark, folder, "orders")),
        line_decisions(table(spark, folder, "lineitem")),
        timeout=REVIEW_DAYS * 86_400,
    )


def key_log_events(spark: SparkSession, folder: str) -> DataFrame:
    """Each event as a small key log of two presses and a line that is none, read back."""
    stamp = F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z: "))
    log = F.concat(stamp, "event_type", F.lit("\nno time: at all\n"), stamp, F.lit("Enter: twice\n"))
    return parse_key_log(table(spark, folder, "events").select("event_id", log.alias("key_log")))


QUERIES = {
    "decision_join": decision_join,
    "decision_join_day": decision_join_day,
    "message_decisions": message_decisions,
    "key_log_events": key_log_events,
}


def _sql_decided(seconds: int) -> str:
    return f"""
      WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
      d AS (SELECT user_id, ts AS hit_at, event_id AS press_id, {SQL_EVENT_KEY} AS key FROM events
            WHERE event_type IN ('click', 'purchase', 'error')),
      j AS (SELECT v.*, hit_at AS decided_at, key AS pressed,
                   row_number() OVER (PARTITION BY event_id ORDER BY hit_at, press_id) AS nth
            FROM v LEFT JOIN d ON v.user_id = d.user_id AND hit_at > ts AND hit_at <= ts + INTERVAL {seconds} SECOND)
      SELECT event_id, user_id, ts, decided_at, pressed, {SQL_DECISION} AS decision FROM j WHERE nth = 1"""


SQL_LINE_KEY = (
    "CASE WHEN l_linestatus = 'O' THEN 'a' WHEN l_returnflag = 'A' THEN 'Enter' "
    "WHEN l_returnflag = 'R' THEN 'Backspace' ELSE 'Shift' END"
)

SQL_MESSAGE_DECISIONS = f"""
      WITH d AS (SELECT l_orderkey, l_shipdate AS hit_at, {SQL_LINE_KEY} AS key FROM lineitem WHERE l_linestatus <> 'O'),
      j AS (SELECT o_orderkey AS message_id, o_orderdate AS ts, hit_at AS decided_at, key AS pressed,
                   row_number() OVER (PARTITION BY o_orderkey ORDER BY hit_at, key) AS nth
            FROM orders LEFT JOIN d
              ON o_orderkey = l_orderkey AND hit_at > o_orderdate AND hit_at <= o_orderdate + INTERVAL {REVIEW_DAYS} DAY)"""

SQL = {
    "decision_join": _sql_decided(300),
    "decision_join_day": _sql_decided(86_400),
    "message_decisions": f"""{SQL_MESSAGE_DECISIONS}
      SELECT message_id, ts, decided_at, pressed, {SQL_DECISION} AS decision FROM j WHERE nth = 1""",
    "key_log_events": """
      SELECT event_id, 0 AS line, ts, event_type AS key FROM events
      UNION ALL SELECT event_id, 2, ts, 'Enter: twice' FROM events""",
}
