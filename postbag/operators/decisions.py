"""Reviewers' key presses and the drafts they answer."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.functions.clock import micros_of
from postbag.functions.labels import ends_review, label_decision
from postbag.operators.ordered import least_after

# Leaves of 2**28 microseconds, about four and a half minutes: the whole history of one key is
# never one task. A century of one key has no more than 12 million leaves above that.
TIME_SHIFTS = (28,)


def parse_key_log(logs: DataFrame, log: str = "key_log") -> DataFrame:
    """Lines ``ISO-time: key`` of a log text to rows ``line, ts, key``; other lines are left out.

    The times end in ``Z``; they come back as UTC wall-clock times.
    """
    line = F.col("_line")
    stamp = F.regexp_extract(line, r"^(\S+): (.+)$", 1)
    rows = logs.select(
        *[c for c in logs.columns if c != log],
        F.posexplode(F.split(F.col(log), "\n")).alias("line", "_line"),
    )
    return (
        rows.withColumns(
            {
                "ts": F.regexp_replace(stamp, "Z$", "").try_cast("timestamp_ntz"),
                "key": F.regexp_extract(line, r"^(\S+): (.+)$", 2),
            }
        )
        .where(F.col("ts").isNotNull() & (F.col("key") != ""))
        .drop("_line")
    )


def await_decision(
    drafts: DataFrame,
    decisions: DataFrame,
    key: str = "message_id",
    tie: str | None = None,
    timeout: float = S.REVIEW_SECONDS,
    accepts: Column | None = None,
    shifts: Sequence[int] = TIME_SHIFTS,
) -> DataFrame:
    """Each draft with the first accepted key after it and within ``timeout`` seconds.

    Adds ``decided_at, pressed, decision``: all NULL is a timeout. Drafts and decisions are put in
    one order by time and each draft looks ahead to the nearest decision, so that no pairs of them
    are ever formed, however many share a key.
    """
    accepted = decisions.where(ends_review(F.col("key")) if accepts is None else accepts)
    accepted = accepted.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    order = [F.col("ts").alias("at")]
    if tie:
        order.append(F.col(tie).alias("tie"))
    presses = accepted.select(
        F.col(key).alias("_id"),
        F.col("ts").alias("_ts"),
        F.struct(*order, F.col("key").alias("pressed")).alias("_press"),
        F.lit(None).cast(drafts.select(F.struct("*").alias("d")).schema["d"].dataType).alias("_draft"),
    )
    waiting = drafts.select(
        F.col(key).alias("_id"),
        F.col("ts").alias("_ts"),
        F.lit(None).cast(presses.schema["_press"].dataType).alias("_press"),
        F.struct("*").alias("_draft"),
    )
    both = waiting.unionByName(presses)
    ahead = least_after(both, ["_id"], micros_of(F.col("_ts")), F.col("_press"), "_next", shifts)
    in_time = micros_of(F.col("_next.at")) <= micros_of(F.col("_ts")) + F.lit(int(timeout * 1_000_000))
    first = F.when(in_time, F.col("_next"))
    return (
        ahead.where(F.col("_draft").isNotNull())
        .select("_draft.*", first.alias("_first"))
        .select(
            *drafts.columns,
            F.col("_first.at").alias("decided_at"),
            F.col("_first.pressed").alias("pressed"),
        )
        .withColumn("decision", label_decision(F.col("pressed")))
    )
