"""From contacts to an outbox: address, page, text, prompts, plan and outcome."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.functions.clock import send_after
from postbag.operators.addresses import resolve_address, with_address
from postbag.operators.decisions import await_decision
from postbag.operators.drafts import Model, personalize
from postbag.operators.outcomes import classify_message, classify_run, isolate_errors
from postbag.operators.pages import contact_pages, needed_pages, with_page_text, with_profile_id
from postbag.operators.quota import plan_by_room, plan_days, plan_shared
from postbag.sources.logs import message_id


def schedule(
    contacts: DataFrame,
    now: Column,
    limit: int | Column | DataFrame,
    sent: int | Column = 0,
    on_file: DataFrame | None = None,
    consumes: Column | None = None,
    dense: bool = False,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Contacts with ``address``, ``send_day`` and ``send_after``.

    ``limit`` is a number or column, or the table of ``daily_room`` where it changes from day to day. With
    ``runs`` (as ``current_runs`` gives them) all runs share it; without, each run has it for itself.
    """
    addressed = with_address(contacts) if on_file is None else resolve_address(contacts, on_file)
    if isinstance(limit, DataFrame):
        if runs is None:
            raise ValueError("a limit that changes is shared: give the runs")
        planned = plan_by_room(addressed, runs, limit, consumes)
    elif runs is not None:
        planned = plan_shared(addressed, runs, limit, sent, consumes)
    else:
        planned = plan_days(addressed, limit, sent, consumes, dense=dense)
    return planned.withColumn("send_after", send_after(now, F.col("send_day")))


def draft_messages(
    contacts: DataFrame,
    pages: DataFrame,
    make_model: Callable[[], Model],
    user_prompt: str | None = None,
    instructions: str | None = None,
    tag: str = "main",
    **options,
) -> DataFrame:
    """Every contact of a run with ``page_text, profile_id, body, subject`` and its own ``error``."""
    text_and_id = with_profile_id(with_page_text(needed_pages(contacts, pages), tag)).drop("html")
    # Written once: the model steps read it several times, and parsing pages is slow.
    found = workspace.keep(contact_pages(with_address(contacts), text_and_id), "found")
    checks = {
        "No address could be inferred.": F.col("address").isNull(),
        "No page is stored.": F.col("page_id").isNull(),
    }
    texts = {"user_prompt": user_prompt, "instructions": instructions}
    written = personalize(
        isolate_errors(found, checks),
        make_model,
        ("run_id", "row_pos"),
        **{name: F.lit(text).cast("string") for name, text in texts.items()},
        **options,
    )
    return isolate_errors(written, {})


def outcomes(
    drafts: DataFrame,
    now: Column,
    review: Column | None = None,
    pressed: Column | None = None,
    no_recipient: Column | None = None,
    send_disabled: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Exactly one row per contact in the shape of the message log, plus ``is_logged`` and ``keep``."""
    no = F.lit(False)
    verdict = classify_message(
        F.col("error"),
        F.col("profile_id"),
        no if no_recipient is None else no_recipient,
        no if review is None else review,
        F.lit(None).cast("string") if pressed is None else pressed,
        no if send_disabled is None else send_disabled,
    )
    return drafts.withColumn("_verdict", verdict).select(
        message_id("run_id", "row_pos").alias("message_id"),
        "run_id",
        "profile_url",
        "body",
        "_verdict.*",
        now.alias("ts"),
        *keep,
    )


def reviewed_outcomes(
    drafts: DataFrame,
    presses: DataFrame,
    key: str = "message_id",
    tie: str | None = None,
    timeout: float = S.REVIEW_SECONDS,
    keep: Sequence[str] = (),
    **rules: Column,
) -> DataFrame:
    """``outcomes`` of drafts that wait for a reviewer from their ``ts`` on; what is pressed decides.

    ``rules`` are those of ``outcomes``, such as ``no_recipient``.
    """
    decided = await_decision(drafts, presses, key, tie, timeout)
    return outcomes(decided, F.col("ts"), review=F.lit(True), pressed=F.col("pressed"), keep=keep, **rules)


def unfinished(contacts: DataFrame, messages: DataFrame) -> DataFrame:
    """The contacts of which the log has no outcome: what is left of runs that broke off, or all of them.

    Whatever the place at which a run broke off, a contact is either logged or planned again.
    """
    keyed = contacts.withColumn("_message", message_id("run_id", "row_pos"))
    logged = messages.select(F.col("message_id").alias("_message"))
    return keyed.join(logged, "_message", "left_anti").drop("_message")


def run_states(contacts: DataFrame, messages: DataFrame, ended: Column, interrupted: Column | None = None) -> DataFrame:
    """``run_id, total, attempted, status, error_message`` of each run, from its contacts and the log."""
    totals = contacts.groupBy("run_id").agg(F.count("*").alias("total"))
    logged = messages.groupBy("run_id").agg(F.count("*").alias("_logged"))
    both = totals.join(logged, "run_id", "left").withColumn("attempted", F.coalesce("_logged", F.lit(0)))
    state = classify_run(F.col("total"), F.col("attempted"), ended, interrupted=interrupted)
    return both.withColumn("_state", state).select("run_id", "total", "attempted", "_state.*")


def log_run_states(states: DataFrame, path: str, ts: Column, seq: int) -> None:
    """Append what became of each run to the run log."""
    cells = {"seq": F.lit(seq), "ts": ts, "file_name": F.lit(None)}
    rows = states.select(
        *[cells.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in S.RUNS_LOG.fields]
    )
    rows.write.mode("append").parquet(path)
