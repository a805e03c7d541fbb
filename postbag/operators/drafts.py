"""Prompts, the model step, and checks on what comes back."""

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from postbag import workspace
from postbag.functions.text import default_if_blank, fill_template, strip
from postbag.operators.ordered import ranged_sum
from postbag.operators.skew import HOT_ROWS, hottest, salted_join

Messages = list[tuple[str, str]]
Model = Callable[[list[Messages]], list[str]]

ANSWERS = "_prompt string, _rows bigint, _value string, _error string"
ANSWER_BATCH = "answer_batch"
#: Prompts a task asks at most: a task that is lost asks so many again.
CALLS = 10_000

# The last message of each prompt, the default request, the fields of a summary.
PROFILE_TEMPLATE = "Here is receiver profile: {profile_summary}"
SUBJECT_TEMPLATE = "Here is email you need to generate subject for: {email_body}"
DEFAULT_USER_PROMPT = "Generate email in english."
SUMMARY_FIELDS = ("Name", "Headline", "About", "Technical Stack", "Skills Endorsement")
SUBJECT_WORDS = 10

# Our own wording of the instructions; callers pass theirs where it matters.
SUMMARY_SYSTEM = (
    "Summarise the profile page below for a technical reader. Leave out former employers, hobbies "
    "and filler. Answer with one line per field, in this form:\n"
    + "\n".join(f"- **{field}**: ..." for field in SUMMARY_FIELDS)
)
MAIL_SYSTEM = (
    "Adapt the reference message to the receiver whose profile follows. Write the body only, "
    "without subject or signature. Name the receiver's technologies rather than those of the "
    "reference. The text must be ready to send: leave no placeholder in square brackets; where "
    "something is unknown, rephrase in general words."
)
MAIL_INSTRUCTIONS = (
    "Write a short, friendly message that offers suitable candidates to the receiver's company: "
    "greet, show that you understand what the company needs, present candidates whose skills fit, "
    "suggest a talk, and close politely. Do not describe the receiver's own career."
)
SUBJECT_SYSTEM = (
    "Write one subject line for the message below: specific, in its tone, and shorter than ten words."
)


def chat(*turns: tuple[str, Column]) -> Column:
    """``array<struct<role, content>>`` in the given order."""
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns])


def summary_messages(page_text: Column, system: str = SUMMARY_SYSTEM) -> Column:
    return chat(("system", F.lit(system)), ("human", page_text))


def mail_messages(
    summary: Column,
    user_prompt: Column | None = None,
    instructions: Column | None = None,
    system: str = MAIL_SYSTEM,
) -> Column:
    """Blank or missing user texts give way to the defaults; braces in them mean nothing."""
    empty = F.lit(None).cast("string")
    return chat(
        ("system", F.lit(system)),
        ("human", default_if_blank(empty if instructions is None else instructions, MAIL_INSTRUCTIONS)),
        ("human", default_if_blank(empty if user_prompt is None else user_prompt, DEFAULT_USER_PROMPT)),
        ("human", fill_template(PROFILE_TEMPLATE, profile_summary=summary)),
    )


def subject_messages(body: Column, system: str = SUBJECT_SYSTEM) -> Column:
    return chat(("system", F.lit(system)), ("human", fill_template(SUBJECT_TEMPLATE, email_body=body)))


def flat_text(messages: Column) -> Column:
    """One line ``role: content`` per message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def _answer(model: Model, prompts: list[Messages]) -> list[tuple[str | None, str | None]]:
    try:
        values = model(prompts)
        if len(values) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts, but {len(values)} answers")
        return [(v, None) for v in values]
    except Exception as e:
        if len(prompts) == 1:
            return [(None, str(e) or type(e).__name__)]
        # One bad prompt must not take the others with it.
        return [answer for p in prompts for answer in _answer(model, [p])]


def ask_model(
    asked: DataFrame,
    make_model: Callable[[], Model],
    batch: int = 32,
    parallelism: int | None = None,
    path: str | None = None,
    label: str = "answers",
    store: str | None = None,
    calls: int = CALLS,
) -> DataFrame:
    """``_prompt, _rows, _value, _error`` for every distinct text of ``asked``'s column ``_asked``.

    ``_prompt`` is the digest of the text, ``_rows`` the number of rows that share it. The answers
    are written to the shared folder before anything is built on them, so that a task lost later
    does not ask again.

    With ``store``, a folder for one model's answers, they outlive the run: what the model has answered before
    is looked up there, only new prompts are asked, by tasks of at most ``calls`` prompts, and their answers
    are added. A prompt that failed is asked again by the next run.
    """

    def ask(rows: Iterator[Row]) -> Iterator[tuple]:
        model = make_model()
        while group := list(islice(rows, batch)):
            prompts = [[(m["role"], m.get("content", "")) for m in json.loads(r["_asked"])] for r in group]
            for row, answer in zip(group, _answer(model, prompts)):
                yield row["_prompt"], row["_rows"], *answer

    def asked_of(prompts: DataFrame) -> DataFrame:
        # Pickled rows come by their size, an Arrow batch by up to 10,000 of any length.
        answers = prompts.rdd.mapPartitions(ask)
        return prompts.sparkSession.createDataFrame(answers, ANSWERS, verifySchema=False)

    keyed = asked.where(F.col("_asked").isNotNull()).select(F.sha2("_asked", 256).alias("_prompt"), "_asked")
    rows = F.count(F.lit(1)).alias("_rows")
    if store is None:
        prompts = keyed.groupBy("_prompt").agg(rows, F.any_value("_asked").alias("_asked"))
        if parallelism:
            prompts = prompts.repartition(parallelism, "_prompt")
        return workspace.keep(asked_of(prompts), label, path)
    # What is to be asked is found by digests alone; texts are shuffled only if there is something new.
    counts = keyed.groupBy("_prompt").agg(rows)
    known = stored_answers(asked.sparkSession, store)
    placed, _ = ranged_sum(counts.join(known.select("_prompt"), "_prompt", "left_anti"), [F.col("_prompt")], None, "_nth")
    tasks = -(-placed.count() // calls)
    batch_path = f"{store}/{ANSWER_BATCH}={uuid.uuid4().hex}"
    if tasks:
        texts = keyed.groupBy("_prompt").agg(F.any_value("_asked").alias("_asked"))
        by_task = placed.join(texts, "_prompt").repartitionById(tasks, F.expr(f"int(_nth div {calls})"))
        added = workspace.keep(asked_of(by_task), label, batch_path)
        failed = added.where("_error IS NOT NULL").select("_prompt", "_value", "_error")
    answers = stored_answers(asked.sparkSession, store)
    if tasks:
        answers = answers.unionByName(failed)
    return workspace.keep(counts.join(answers, "_prompt").select("_prompt", "_rows", "_value", "_error"), label, path)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """``_prompt, _value, _error`` of all prompts a store has an answer to, one row each; none if there is no store.

    Runs at the same time may both have asked a prompt; one of their answers is taken.
    """
    none = workspace.keep(spark.createDataFrame([], ANSWERS), "answers", f"{store}/{ANSWER_BATCH}=none")
    answers = spark.read.schema(none.schema).parquet(store).where("_error IS NULL")
    one = answers.groupBy("_prompt").agg(F.min("_value").alias("_value"))
    return one.withColumn("_error", F.lit(None).cast("string"))


def complete(
    df: DataFrame,
    messages: Column,
    make_model: Callable[[], Model],
    out: str,
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
    **options,
) -> DataFrame:
    """Add ``out``, a ``struct<value, error>``: the model's answer to ``messages``.

    ``make_model`` is called once per task and gives a function from a list of prompts to a list
    of answers. Equal prompts are asked once. Rows whose messages are NULL are not asked. ``options`` are those
    of ``ask_model``, such as ``store``.
    """
    asked = F.to_json(messages)
    answered = ask_model(df.select(asked.alias("_asked")), make_model, label=f"answers-{out}", **options)
    joined = salted_join(
        df.withColumn("_prompt", F.sha2(asked, 256)),
        answered.drop("_rows"),
        ["_prompt"],
        spread,
        "left",
        hottest(answered, ["_prompt"], "_rows", hot_rows),
    )
    answer = F.struct(F.col("_value").alias("value"), F.col("_error").alias("error"))
    return joined.withColumn(out, answer).drop("_prompt", "_value", "_error")


def personalize(
    df: DataFrame,
    make_model: Callable[[], Model],
    ids: Sequence[str],
    page_text: str = "page_text",
    user_prompt: Column | None = None,
    instructions: Column | None = None,
    **options,
) -> DataFrame:
    """Add ``summary, body, subject, error``: page to summary, summary to body, body to subject.

    Every row comes back once, also where ``ids`` are NULL or repeat: rows are written with a number of
    their own before the first step, and that number is what they are joined by. A step that failed
    leaves its error; the steps after it are not asked, nor is any step for a row that comes with an
    ``error``. The steps pass on ids and answers only, each written before the next one starts, and the
    rows themselves are joined once, at the end.
    """
    df = workspace.keep(df.withColumn("_row", F.monotonically_increasing_id()), "to-write")
    ids = ["_row", *(i for i in ids if i != "_row")]
    none = F.lit(None).cast("string")

    def step(rows: DataFrame, messages: Column, out: str) -> DataFrame:
        done = complete(rows, messages, make_model, "_answer", ids, **options)
        error = F.col("_answer.error")
        if "_failed" in rows.columns:
            error = F.coalesce("_failed", error)
        return done.withColumns({out: F.col("_answer.value"), "_failed": error}).drop("_answer")

    sound = F.col("error").isNull() if "error" in df.columns else F.lit(True)
    start = df.select(
        *ids,
        F.when(sound, F.col(page_text)).alias("_page"),
        (none if user_prompt is None else user_prompt).alias("_request"),
        (none if instructions is None else instructions).alias("_instructions"),
    )
    summary = F.when(F.col("_page").isNotNull(), summary_messages(F.col("_page")))
    rows = step(start, summary, "summary").drop("_page")
    rows = workspace.keep(rows, "summaries")
    mail = mail_messages(F.col("summary"), F.col("_request"), F.col("_instructions"))
    mail = F.when(F.col("summary").isNotNull(), mail)
    rows = step(rows, mail, "body").drop("_request", "_instructions")
    rows = workspace.keep(rows, "bodies")
    subject = F.when(F.col("body").isNotNull(), subject_messages(F.col("body")))
    rows = step(rows, subject, "subject").withColumnRenamed("_failed", "error")
    if "error" in df.columns:
        before = df.withColumnRenamed("error", "_before")
        joined = before.join(rows.drop(*ids[1:]), "_row")
        return joined.withColumn("error", F.coalesce("_before", "error")).drop("_before", "_row")
    return df.join(rows.drop(*ids[1:]), "_row").drop("_row")


def placeholders(text: Column) -> Column:
    """Number of ``[placeholders]`` left in a text."""
    return F.regexp_count(text, F.lit(r"\[[^\]]+\]"))


def word_count(text: Column) -> Column:
    stripped = strip(text)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"(?U)[\s\x1C-\x1F]+")))


def summary_field(summary: Column, field: str) -> Column:
    """Text of a ``- **Field**: text`` line; NULL if the summary has none."""
    found = F.regexp_extract(summary, rf"(?m)^- \*\*{field}\*\*: (.+)$", 1)
    return F.nullif(found, F.lit(""))


def check_output(
    df: DataFrame, body: str = "body", subject: str | None = "subject", summary: str | None = None
) -> DataFrame:
    """Whether texts keep the rules their prompts state."""
    checks = {"body_ready": placeholders(F.col(body)) == 0}
    if subject:
        checks["subject_short"] = word_count(F.col(subject)) < SUBJECT_WORDS
    if summary:
        for field in SUMMARY_FIELDS:
            name = "has_" + field.lower().replace(" ", "_")
            checks[name] = summary_field(F.col(summary), field).isNotNull()
    return df.withColumns(checks)
