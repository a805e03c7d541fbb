"""Counting against a daily limit and spreading a run over days."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.functions.clock import day_bounds, day_of, to_zone
from postbag.functions.labels import int_or_default
from postbag.operators.ordered import SHIFTS, marks_reached, ranged_sum, sum_before
from postbag.operators.skew import salted_join


def _with_statuses(messages: DataFrame, statuses: Sequence[str] | None) -> DataFrame:
    return messages if statuses is None else messages.where(F.col("status").isin(*statuses))


def sent_today(
    messages: DataFrame, day: dt.date, zone: str = "UTC", statuses: Sequence[str] | None = None
) -> DataFrame:
    """One row, ``sent``: outcomes logged on a calendar day of ``zone``, of any status by default."""
    start, end = day_bounds(day, zone)
    on_day = _with_statuses(messages, statuses).where((F.col("ts") >= start) & (F.col("ts") < end))
    if "day" in messages.columns:  # a log kept in one folder per UTC day
        on_day = on_day.where(F.col("day").between(F.to_date(start), F.to_date(end)))
    return on_day.agg(F.count(F.lit(1)).alias("sent"))


def daily_counts(
    messages: DataFrame, zone: str = "UTC", statuses: Sequence[str] | None = None
) -> DataFrame:
    """``day, sent`` for all days."""
    return (
        _with_statuses(messages, statuses)
        .groupBy(day_of(F.col("ts"), zone).alias("day"))
        .agg(F.count(F.lit(1)).alias("sent"))
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def get_setting(
    settings: DataFrame, key: str = S.DAILY_LIMIT_KEY, default: int = S.DEFAULT_DAILY_LIMIT
) -> DataFrame:
    """One row, ``value``: the last value written for a key, or the default. No key, still a row."""
    last = settings.where(F.col("key") == key).agg(
        F.max_by("value", F.struct("ts", "seq")).alias("value")
    )
    return last.select(int_or_default(F.col("value"), default).alias("value"))


def with_setting(df: DataFrame, setting: DataFrame, out: str = "daily_limit") -> DataFrame:
    """Add a one-row look-up as a column: a scalar subquery, evaluated once."""
    return df.withColumn(out, setting.scalar())


def _positive(limit: int | Column) -> Column:
    if not isinstance(limit, Column):
        if limit <= 0:
            raise ValueError("the daily limit must be positive")
        return F.lit(int(limit))
    return F.when(limit > 0, limit).otherwise(F.raise_error("the daily limit must be positive"))


def plan_days(
    contacts: DataFrame,
    limit: int | Column,
    sent: int | Column = 0,
    consumes: Column | None = None,
    run: Sequence[str] = ("run_id",),
    position: str = "row_pos",
    dense: bool = False,
    out: str = "send_day",
    shifts: Sequence[int] = SHIFTS,
) -> DataFrame:
    """Give every contact a send day: day 0 has room for ``limit - sent``, later days for ``limit``.

    ``consumes`` marks the rows that use quota (all by default). With ``dense=True`` positions are
    gapless from 0 in every run, and the plan is a projection without any shuffle.
    """
    room = _positive(limit)
    used = F.least(sent if isinstance(sent, Column) else F.lit(int(sent)), room)
    if dense and consumes is None:
        return contacts.withColumn(out, F.floor((used + F.col(position)) / room).cast("int"))
    counts = F.lit(1) if consumes is None else F.coalesce(consumes.cast("int"), F.lit(0))
    ahead = sum_before(contacts, run, position, counts, "_ahead", shifts)
    day = F.floor((used + F.col("_ahead")) / room).cast("int")
    return ahead.withColumn(out, day).drop("_ahead")


def in_sending_order(
    contacts: DataFrame,
    runs: DataFrame,
    consumes: Column | None = None,
    position: str = "row_pos",
    tie: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """All contacts of all runs in one order, with ``_ahead``: the quota used by those before each.

    Runs go by when they ``started`` (of two at the same time by name; ones not in ``runs`` last), rows by
    position, then by ``tie``. Equal positions and missing ones (last) are ordered all the same.
    """
    known = runs.groupBy("run_id").agg(F.min("started").alias("_started"))
    spread = [c for c in dict.fromkeys((position, *tie)) if c != "run_id"]
    timed = salted_join(contacts, known, ["run_id"], spread, "left")
    keys = ("_started", "run_id", position, *tie)
    rows, parts = ranged_sum(timed, [F.col(c).asc_nulls_last() for c in keys], consumes, "_ahead")
    return rows.drop("_started"), parts


def plan_shared(
    contacts: DataFrame,
    runs: DataFrame,
    limit: int | Column,
    sent: int | Column = 0,
    consumes: Column | None = None,
    position: str = "row_pos",
    tie: Sequence[str] = (),
    out: str = "send_day",
) -> DataFrame:
    """A send day for every contact under one daily limit that all runs share.

    Day 0 has room for ``limit - sent``, later days for ``limit``. No day has more rows that use quota than
    that, however many runs there are and also where positions repeat.
    """
    room = _positive(limit)
    used = F.least(sent if isinstance(sent, Column) else F.lit(int(sent)), room)
    rows, _ = in_sending_order(contacts, runs, consumes, position, tie)
    day = F.floor((used + F.col("_ahead")) / room).cast("int")
    return rows.withColumn(out, day).drop("_ahead", "_part")


def daily_room(
    settings: DataFrame,
    now: Column,
    sent: DataFrame | None = None,
    key: str = S.DAILY_LIMIT_KEY,
    default: int = S.DEFAULT_DAILY_LIMIT,
    zone: str = S.SEND_ZONE,
    hour: int = S.SEND_HOUR,
) -> DataFrame:
    """``day_no, day, daily_limit, room, before``: the room of each day from ``now`` on, and of all days before it.

    Day 0 goes by the last limit written until ``now``, each later one by the last written until it opens
    at ``hour``. ``sent`` has counts by ``day``, as ``daily_counts`` gives them, and takes room away; a
    limit that is used up, zero or negative leaves none. The table ends with the day from which nothing
    changes any more, so it has as many rows as days are logged ahead of ``now``.
    """
    today = F.to_date(to_zone(now, zone))
    local = to_zone(F.col("ts"), zone)
    opened = F.to_date(local).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))
    from_day = F.when(F.col("ts") <= now, 0).otherwise(
        F.greatest(F.datediff(F.to_date(local), today) + F.when(local > opened, 1).otherwise(0), F.lit(1))
    )
    writes = settings.where(F.col("key") == key).groupBy(from_day.alias("day_no")).agg(
        F.max_by("value", F.struct("ts", "seq")).alias("_value"), F.lit(True).alias("_written")
    )
    counts = None
    if sent is not None:
        counts = sent.select(F.datediff("day", today).alias("day_no"), F.col("sent").alias("_sent")).where("day_no >= 0")
    spans = writes.select("day_no") if counts is None else writes.select("day_no").unionAll(counts.selectExpr("day_no + 1"))
    last = spans.agg(F.coalesce(F.max("day_no"), F.lit(0)).alias("last"))
    days = last.select(F.explode(F.sequence(F.lit(0), "last")).alias("day_no")).join(writes, "day_no", "left")
    days = days.withColumn("_sent", F.lit(0)) if counts is None else days.join(counts, "day_no", "left")
    so_far = Window.orderBy("day_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.last(F.when(F.col("_written"), F.struct("_value")), ignorenulls=True).over(so_far).getField("_value")
    days = days.withColumn("daily_limit", int_or_default(value, default))
    days = days.withColumn("room", F.greatest(F.col("daily_limit") - F.coalesce("_sent", F.lit(0)), F.lit(0)).cast("bigint"))
    before = F.sum("room").over(so_far.orderBy("day_no").rowsBetween(Window.unboundedPreceding, -1))
    return days.select(
        "day_no",
        F.date_add(today, F.col("day_no")).alias("day"),
        "daily_limit",
        "room",
        F.coalesce(before, F.lit(0).cast("bigint")).alias("before"),
    )


def plan_by_room(
    contacts: DataFrame,
    runs: DataFrame,
    room: DataFrame,
    consumes: Column | None = None,
    position: str = "row_pos",
    tie: Sequence[str] = (),
    out: str = "send_day",
) -> DataFrame:
    """A send day for every contact of all runs under a limit that changes from day to day.

    ``room`` comes from ``daily_room``. Days without room are passed over; from its last day on the limit
    stays, and what would come behind a last limit of zero has no day.
    """
    room = workspace.keep(room, "room")  # a few rows that several places read
    rows, parts = in_sending_order(contacts, runs, consumes, position, tie)
    # a row's day is the last one of which all days before it have no more room than is used ahead of the row
    met = marks_reached(rows, parts, "_ahead", room, "before", "_days")
    last = room.agg(F.max_by(F.struct("day_no", "before", F.col("daily_limit").alias("each")), "day_no").alias("end"))
    end = last.scalar()
    beyond = F.col("_ahead") - end.getField("before")
    after = F.when(
        end.getField("each") > 0, end.getField("day_no") + F.floor(beyond / end.getField("each")).cast("int")
    )
    day = F.when(F.col("_days") <= end.getField("day_no"), F.col("_days") - 1).otherwise(after)
    return met.withColumn(out, day.cast("int")).drop("_ahead", "_part", "_days")
