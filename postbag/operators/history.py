"""Reading the logs: last state per key, runs with their messages, summaries and views."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.operators.skew import salted_join


def append_log(log: DataFrame, *more: DataFrame) -> DataFrame:
    """Logs one after another, matched by column name."""
    for part in more:
        log = log.unionByName(part)
    return log


def where_equals(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    return df


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key. Spark keeps one row per key and task before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def newest_first(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """Newest rows first; equal times by id, so that the order is determinate."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc())


def messages_of_run(messages: DataFrame, run_id: str) -> DataFrame:
    """Messages of one run, newest first."""
    return newest_first(where_equals(messages, run_id=run_id), "ts", "message_id")


def first_row(df: DataFrame, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(1)


def run_history(
    runs: DataFrame,
    messages: DataFrame,
    spread: Sequence[str] = ("message_id",),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Every run with its messages; a run without messages once, with NULLs.

    Where both have a column, that of the run is prefixed with ``run_``.
    """
    both = (set(runs.columns) & set(messages.columns)) - {"run_id"}
    runs = runs.withColumnsRenamed({c: f"run_{c}" for c in both})
    return salted_join(messages, runs, ["run_id"], spread, "right", hot)


def orphan_messages(
    messages: DataFrame,
    runs: DataFrame,
    spread: Sequence[str] = ("message_id",),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Messages whose run is not in the run log."""
    known = runs.select("run_id").distinct()
    return salted_join(messages, known, ["run_id"], spread, "left_anti", hot)


def run_summary(messages: DataFrame, states: Mapping[str, str] | None = None) -> DataFrame:
    """Per run: rows and rows by status."""
    states = states or {
        "sent": S.SENT,
        "skipped": S.SKIPPED,
        "failed": S.FAILED,
        "not_attempted": S.NOT_ATTEMPTED,
    }
    return messages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == status).alias(name) for name, status in states.items()],
    )


def title_headers(df: DataFrame) -> DataFrame:
    """``error_message`` becomes ``Error Message``, for showing a table."""
    return df.withColumnsRenamed({c: c.replace("_", " ").title() for c in df.columns})


def message_detail(messages: DataFrame, chosen: str | DataFrame, key: str = "message_id") -> DataFrame:
    """Full text of one chosen message, or of all messages in a table of chosen ids."""
    if isinstance(chosen, DataFrame):
        picked = messages.join(chosen.select(key), key, "left_semi")
    else:
        picked = messages.where(F.col(key) == chosen)
    return picked.select(key, "body")
