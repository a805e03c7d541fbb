"""What became of a message and of a run, read off the evidence."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.functions.clock import seconds_until


def _outcome(status: str | None, message: str | Column | None, logged: bool) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(
        F.lit(status).cast("string").alias("status"),
        text.cast("string").alias("error_message"),
        F.lit(logged).alias("is_logged"),
    )


def classify_message(
    error: Column,
    profile_id: Column,
    no_recipient: Column,
    review: Column,
    pressed: Column,
    send_disabled: Column,
    attempted: Column | None = None,
    done: str = S.READY,
) -> Column:
    """``struct<status, error_message, is_logged>`` of one message; the first rule that holds decides.

    ``pressed`` is the first accepted review key in time, NULL if none came. Flags count as false
    when NULL.
    """

    def yes(flag: Column) -> Column:
        return F.coalesce(flag, F.lit(False))

    rules = [] if attempted is None else [(~yes(attempted), (S.NOT_ATTEMPTED, None, False))]
    rules += [
        (error.isNotNull(), (S.FAILED, error, True)),
        (profile_id.isNull(), (S.FAILED, S.NO_PROFILE_ID, True)),
        (yes(no_recipient), (None, None, False)),
        (yes(review) & (pressed == "Backspace"), (S.SKIPPED, S.USER_SKIPPED, True)),
        (yes(review) & (pressed != "Enter"), (S.FAILED, S.UNRECOGNIZED_KEY, True)),
        (yes(review) & pressed.isNull(), (S.FAILED, S.REVIEW_TIMEOUT, True)),
        (yes(send_disabled), (S.FAILED, S.SEND_DISABLED, True)),
    ]
    chain = F
    for holds, outcome in rules:
        chain = chain.when(holds, _outcome(*outcome))
    return chain.otherwise(_outcome(done, None, True))


def classify_run(
    total: Column,
    attempted: Column,
    ended: Column,
    rejected: Column | None = None,
    startup_error: Column | None = None,
    interrupted: Column | None = None,
    unexpected_error: Column | None = None,
) -> Column:
    """``struct<status, error_message>`` of a whole run.

    A run is complete once every row was attempted; one that ended earlier for no given reason has
    failed, one that did not end is still running.
    """
    none = F.lit(None).cast("string")

    def state(status: str, message: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), message.cast("string").alias("error_message"))

    def given(reason: Column | None) -> Column:
        return none if reason is None else reason

    return (
        F.when(given(rejected).isNotNull(), state(S.ERROR, given(rejected)))
        .when(
            given(startup_error).isNotNull(),
            state(S.FAILED, F.concat(F.lit(S.RUN_STARTUP_PREFIX), given(startup_error))),
        )
        .when(
            F.coalesce(F.lit(False) if interrupted is None else interrupted, F.lit(False)),
            state(S.INTERRUPTED, F.lit(S.RUN_INTERRUPTED)),
        )
        .when(
            given(unexpected_error).isNotNull(),
            state(S.FAILED, F.concat(F.lit(S.RUN_UNEXPECTED_PREFIX), given(unexpected_error))),
        )
        .when(attempted >= total, state(S.COMPLETED, F.lit(S.RUN_COMPLETED)))
        .when(F.coalesce(ended, F.lit(False)), state(S.FAILED, F.lit(S.RUN_ENDED)))
        .otherwise(state(S.RUNNING, none))
    )


def unfinished_runs(runs: DataFrame, as_of: Column) -> DataFrame:
    """Runs still in state Running, with the seconds since that was logged."""
    open_runs = runs.where((F.col("status") == S.RUNNING) & (F.col("ts") <= as_of))
    return open_runs.withColumn("open_seconds", seconds_until(F.col("ts"), as_of))


def isolate_errors(df: DataFrame, checks: Mapping[str, Column], body: str = "body") -> DataFrame:
    """Give each row its own ``error`` instead of failing the job.

    ``checks`` maps a message to the condition under which a row gets it; the first that holds
    counts. A row without a body yet gets an empty one.
    """
    found = [F.when(bad, F.lit(message)) for message, bad in checks.items()]
    if "error" in df.columns:
        found.insert(0, F.col("error"))
    df = df.withColumn("error", F.coalesce(*found, F.lit(None).cast("string")))
    if body in df.columns:
        df = df.withColumn(body, F.coalesce(F.col(body), F.lit("")))
    return df
