"""Streaming counts and decisions."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from postbag import schema as S
from postbag.functions.labels import ends_review, label_decision


def stream_daily_counts(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """``day, sent`` per UTC day, from a stream with event time ``ts``.

    In update mode the current day's count comes out after every batch, in append mode each day's
    once it is closed.
    """
    day = F.window(ts, "1 day")
    return (
        messages.groupBy(day.alias("_day"))
        .agg(F.count(F.lit(1)).alias("sent"))
        .select(_utc_day(F.col("_day.start")).alias("day"), "sent")
    )


def _utc_day(instant: Column) -> Column:
    """UTC day of an instant, whatever the session zone."""
    return F.date_add(
        F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(instant) / 86_400).cast("int")
    )


def stream_decisions(
    drafts: DataFrame,
    decisions: DataFrame,
    key: str = "message_id",
    timeout_seconds: float = S.REVIEW_SECONDS,
    accepts: Column | None = None,
    slices: int = 64,
) -> DataFrame:
    """Each draft with its first accepted key within the time limit, as soon as that is certain.

    ``drafts`` and ``decisions`` are streams with event time ``ts`` and the same ``key``; a draft's
    key is its own (of several the first counts). Gives ``key, drafted_at, decided_at, pressed, decision`` in
    append mode.

    A draft is due at the first key pressed, for an earlier one may still come until then, or at the end of
    the time limit; a timer on event time waits for that. Then the decision comes out and what was kept is
    freed; keys that no draft can precede any more are freed likewise. Bounds are exact to the microsecond,
    timers to the millisecond after. State and timers belong to ``slices`` of the keys, by hash, so that a
    task handles the rows of many keys at once; as many slices stay with a stream for its life.
    """
    accepted = decisions.where(ends_review(F.col("key")) if accepts is None else accepts)
    none = F.lit(None).cast("string")
    at = F.unix_micros("ts").alias("at")
    rows = drafts.select(F.col(key).alias("id"), "ts", at, none.alias("pressed"), F.lit(True).alias("draft"))
    presses = accepted.select(F.col(key).alias("id"), "ts", at, F.col("key").alias("pressed"), F.lit(False).alias("draft"))
    both = rows.unionByName(presses).where(F.col("id").isNotNull() & F.col("ts").isNotNull())
    kind = drafts.schema[key].dataType.simpleString()
    sliced = both.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    decided = sliced.groupBy("slice").applyInPandasWithState(
        _decide(round(timeout_seconds * 1_000_000)),
        f"id {kind}, drafted long, decided long, pressed string",
        f"ids array<{kind}>, drafted array<long>, of array<{kind}>, ats array<long>, keys array<string>",
        "append",
        "EventTimeTimeout",
    )
    return decided.select(
        F.col("id").alias(key),
        F.timestamp_micros("drafted").alias("drafted_at"),
        F.timestamp_micros("decided").alias("decided_at"),
        "pressed",
        label_decision(F.col("pressed")).alias("decision"),
    )


def _due(at: int) -> int:
    """The millisecond after a time, at which all that is not later has been seen."""
    return at // 1000 + 1


def _decide(timeout: int):
    """What the rows and the timer of a slice do to its state; times in microseconds."""

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, drafted, of, ats, keys = state.get if state.exists else ([],) * 5
        waiting, presses = dict(zip(ids, drafted)), list(zip(of, ats, keys))
        for frame in frames:
            for i, at, pressed, draft in zip(*(frame[c].tolist() for c in ("id", "at", "pressed", "draft"))):
                if draft:
                    waiting[i] = min(at, waiting.get(i, at))
                else:
                    presses.append((i, at, pressed))
        mark = state.getCurrentWatermarkMs()
        first, kept = {}, []
        for i, at, pressed in presses:
            start = waiting.get(i)
            if start is None:
                if _due(at) > mark:  # a draft may still come before it
                    kept.append((i, at, pressed))
            elif start < at <= start + timeout:
                first[i] = min((at, pressed), first.get(i, (at, pressed)))
        done, open_, timers = [], [], [_due(at) for _, at, _ in kept]
        for i, start in waiting.items():
            at, pressed = first.get(i, (None, None))
            due = _due(start + timeout if at is None else at)
            if due <= mark:
                done.append((i, start, at, pressed))
            else:
                open_.append((i, start))
                timers.append(due)
                if at is not None:
                    kept.append((i, at, pressed))
        if done:
            columns = dict(zip(("id", "drafted", "decided", "pressed"), map(list, zip(*done))))
            yield pd.DataFrame(columns | {"decided": pd.array(columns["decided"], "Int64")})
        if timers:
            state.update(tuple([row[k] for row in rows] for rows, n in ((open_, 2), (kept, 3)) for k in range(n)))
            state.setTimeoutTimestamp(min(timers))
        else:
            state.remove()

    return run
