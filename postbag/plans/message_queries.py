"""Prompts, the model step, checks and chunks."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import workspace
from postbag.functions.text import chunk_text
from postbag.operators import drafts as D
from postbag.plans.tables import sql_strip, sql_text, table


def stand_in_model() -> D.Model:
    """Answers with the length and the digest of everything it was told."""

    def answer(prompts: list[D.Messages]) -> list[str]:
        told = ["\n".join(f"{role}: {content}" for role, content in prompt) for prompt in prompts]
        return [f"{len(t)} characters, {hashlib.md5(t.encode()).hexdigest()}" for t in told]

    return answer


def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    """All three prompts of every document, its language as the request and its source as instructions."""
    request = F.when(F.col("lang") != "en", F.concat(F.lit(" Write {in} "), "lang"))
    documents = table(spark, folder, "documents")
    kinds = {
        "summary": D.summary_messages(F.col("text")),
        "mail": D.mail_messages(F.col("text"), request, F.col("source")),
        "subject": D.subject_messages(F.col("text")),
    }
    return documents.select(
        "doc_id",
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(k) for k in kinds]), F.array(*[D.flat_text(m) for m in kinds.values()])
        )).alias("kind", "prompt"),
    )


def personalized(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    request = F.when(F.col("lang") != "en", F.concat(F.lit("Write in "), "lang"))
    written = D.personalize(
        documents, stand_in_model, ("doc_id",), page_text="text", user_prompt=request, instructions=F.col("source")
    )
    return written.select("doc_id", "summary", "body", "subject", "error")


def mute_model() -> D.Model:
    """Refuses all prompts: whoever gets an answer has it from a store."""

    def answer(prompts: list[D.Messages]) -> list[str]:
        raise RuntimeError("asked again")

    return answer


def answered_again(spark: SparkSession, folder: str) -> DataFrame:
    """As ``personalized``, but by a second run that finds all its answers in the store of the first."""
    documents = table(spark, folder, "documents")
    request = F.when(F.col("lang") != "en", F.concat(F.lit("Write in "), "lang"))
    store, written = workspace.fresh(spark, "answer-store"), documents
    for model in (stand_in_model, mute_model):
        written = D.personalize(
            documents, model, ("doc_id",), "text", request, F.col("source"), store=store
        )
    return written.select("doc_id", "summary", "body", "subject", "error")


def output_checks(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.concat(F.lit("Hello [First name]! "), "text", F.lit(" [Sign\noff]")))
        .otherwise(F.col("text"))
        .alias("body"),
        F.col("text").alias("subject"),
        F.concat(F.lit("- **Name**: "), "conv_id", F.lit("\n- **About**: "), "text", F.lit("\n - **Headline**: x\n"))
        .alias("summary"),
    )
    checked = D.check_output(said, summary="summary").withColumns(
        {"placeholders": D.placeholders(F.col("body")), "words": D.word_count(F.col("subject"))}
    )
    return checked.drop("body", "subject", "summary")


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("pos", "chunk"))


QUERIES = {
    "prompt_text": prompt_text,
    "personalized": personalized,
    "answered_again": answered_again,
    "output_checks": output_checks,
    "text_chunks": text_chunks,
}


def _sql_chat(*turns: tuple[str, str]) -> str:
    return " || chr(10) || ".join(f"'{role}: ' || {text}" for role, text in turns)


def sql_summary(text: str) -> str:
    return _sql_chat(("system", sql_text(D.SUMMARY_SYSTEM)), ("human", text))


def sql_mail(summary: str, request: str, instructions: str) -> str:
    return _sql_chat(
        ("system", sql_text(D.MAIL_SYSTEM)),
        ("human", instructions),
        ("human", request),
        ("human", f"'Here is receiver profile: ' || {summary}"),
    )


def _sql_request(request: str) -> str:
    return f"CASE WHEN lang <> 'en' THEN {request} ELSE {sql_text(D.DEFAULT_USER_PROMPT)} END"


def sql_subject(body: str) -> str:
    return _sql_chat(
        ("system", sql_text(D.SUBJECT_SYSTEM)),
        ("human", f"'Here is email you need to generate subject for: ' || {body}"),
    )


def sql_answer(prompt: str) -> str:
    return f"length({prompt}) || ' characters, ' || md5({prompt})"


SQL_PERSONALIZED = f"""
      WITH s AS (SELECT *, {sql_summary('text')} AS p1 FROM documents),
      t AS (SELECT *, {sql_answer('p1')} AS summary FROM s),
      u AS (SELECT *, {sql_mail('summary', _sql_request("'Write in ' || lang"), 'source')} AS p2 FROM t),
      v AS (SELECT *, {sql_answer('p2')} AS body FROM u),
      w AS (SELECT *, {sql_subject('body')} AS p3 FROM v)
      SELECT doc_id, summary, body, {sql_answer('p3')} AS subject, CAST(NULL AS VARCHAR) AS error FROM w"""

_WORDS = rf"len(string_split_regex({sql_strip('text')}, '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+'))"
_BODY = "CASE WHEN role = 'user' THEN 'Hello [First name]! ' || text || ' [Sign' || chr(10) || 'off]' ELSE text END"

SQL = {
    "prompt_text": f"""
      SELECT doc_id, 'summary' AS kind, {sql_summary('text')} AS prompt FROM documents
      UNION ALL SELECT doc_id, 'mail', {sql_mail('text', _sql_request("'Write {in} ' || lang"), 'source')} FROM documents
      UNION ALL SELECT doc_id, 'subject', {sql_subject('text')} FROM documents""",
    "personalized": SQL_PERSONALIZED,
    "answered_again": SQL_PERSONALIZED,
    "output_checks": rf"""
      WITH c AS (SELECT conv_id, turn, CAST(len(regexp_extract_all({_BODY}, '\[[^\]]+\]')) AS INTEGER) AS placeholders,
                        CAST(CASE WHEN {sql_strip('text')} = '' THEN 0 ELSE {_WORDS} END AS INTEGER) AS words,
                        regexp_matches(text, '^[^\r\n\x{{85}}\x{{2028}}\x{{2029}}]') OR
                        regexp_matches(text, '(?m)^- \*\*About\*\*: .') AS has_about,
                        text FROM conversations)
      SELECT conv_id, turn, placeholders = 0 AS body_ready, words < 10 AS subject_short,
             true AS has_name, false OR regexp_matches(text, '(?m)^- \*\*Headline\*\*: .') AS has_headline, has_about,
             regexp_matches(text, '(?m)^- \*\*Technical Stack\*\*: .') AS has_technical_stack,
             regexp_matches(text, '(?m)^- \*\*Skills Endorsement\*\*: .') AS has_skills_endorsement,
             placeholders, words FROM c""",
    "text_chunks": """
      SELECT doc_id, CAST(i AS INTEGER) AS pos, substr(text, 20 * i + 1, 20) AS chunk
      FROM documents, LATERAL unnest(generate_series(0, (length(text) + 19) // 20 - 1)) AS g(i)
      WHERE length(text) > 0""",
}
