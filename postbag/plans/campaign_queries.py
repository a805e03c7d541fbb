"""The whole way from contacts and stored pages to logged outcomes and a day plan."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.operators import drafts as D
from postbag.operators.quota import plan_days
from postbag.plans.message_queries import (
    sql_answer,
    sql_mail,
    sql_subject,
    sql_summary,
    stand_in_model,
)
from postbag.plans.outbox import draft_messages, outcomes
from postbag.plans.page_queries import sql_page_text
from postbag.plans.tables import sql_slug, sql_text, table

NOW = "2024-01-15 03:30:00"


def campaign_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored page is one contact's profile; Spanish ones lack the id, some contacts the company."""
    url, language = F.col("url"), F.split_part("url", F.lit("/"), F.lit(4))
    stored = table(spark, folder, "pages")
    contacts = stored.select(
        language.alias("run_id"),
        F.col("page_id").alias("row_pos"),
        url.alias("profile_url"),
        F.when(url.startswith("http:"), "known@mail.example").alias("email"),
        F.lit("Al").alias("first_name"),
        F.lit("Fox").alias("last_name"),
        F.when(~url.endswith("#top"), F.split_part("url", F.lit("/"), F.lit(3))).alias("company"),
    )
    data = F.concat(
        F.lit(f'<code>{{"data":{{"data":{{"{S.ID_MARKER}":{{"*elements":["urn:li:x:'),
        "page_id",
        F.lit('"]}}}}</code>'),
    )
    pages = stored.withColumn("html", F.when(language == "es", F.col("html")).otherwise(F.concat("html", data)))
    drafts = draft_messages(contacts, pages, stand_in_model, tag="article")
    result = outcomes(
        drafts,
        F.lit(NOW).cast("timestamp_ntz"),
        review=F.col("run_id") != "en",
        pressed=F.when(F.col("run_id") == "fr", "Enter").when(F.col("run_id") == "de", "Backspace"),
        no_recipient=F.contains("profile_url", F.lit("page=")),
        send_disabled=F.col("profile_url").endswith(".html"),
        keep=("row_pos", "address", "subject"),
    )
    return plan_days(result, 20, 3, F.col("is_logged"))


QUERIES = {"campaign_outcomes": campaign_outcomes}

_NO_ADDRESS = "No address could be inferred."

SQL = {
    "campaign_outcomes": f"""
      WITH t AS ({sql_page_text()}),
      c AS (SELECT page_id AS row_pos, url AS profile_url, split_part(url, '/', 4) AS run_id, page_text,
                   CASE WHEN url LIKE 'http:%' THEN 'known@mail.example'
                        WHEN url NOT LIKE '%#top' THEN 'al.fox@' || {sql_slug("split_part(url, '/', 3)")} || '.com'
                   END AS address
            FROM pages JOIN t USING (page_id)),
      p1 AS (SELECT *, {sql_summary('page_text')} AS asked1 FROM c),
      p2 AS (SELECT *, {sql_answer('asked1')} AS summary FROM p1),
      p3 AS (SELECT *, {sql_mail('summary', sql_text(D.DEFAULT_USER_PROMPT), sql_text(D.MAIL_INSTRUCTIONS))} AS asked2
             FROM p2),
      p4 AS (SELECT *, {sql_answer('asked2')} AS answer2 FROM p3),
      p5 AS (SELECT *, {sql_subject('answer2')} AS asked3 FROM p4),
      r AS (SELECT *, CASE WHEN address IS NULL THEN 1 WHEN run_id = 'es' THEN 2 WHEN profile_url LIKE '%page=%' THEN 3
                           WHEN run_id = 'de' THEN 4 WHEN profile_url LIKE '%.html' THEN 5 ELSE 6 END AS rule FROM p5)
      SELECT sha256(run_id || chr(31) || row_pos) AS message_id, run_id, row_pos, profile_url, address,
             CASE WHEN address IS NULL THEN '' ELSE answer2 END AS body,
             CASE WHEN address IS NOT NULL THEN {sql_answer('asked3')} END AS subject,
             CASE WHEN rule = 3 THEN NULL WHEN rule = 4 THEN '{S.SKIPPED}' WHEN rule = 6 THEN '{S.READY}'
                  ELSE '{S.FAILED}' END AS status,
             CASE rule WHEN 1 THEN '{_NO_ADDRESS}' WHEN 2 THEN '{S.NO_PROFILE_ID}' WHEN 4 THEN '{S.USER_SKIPPED}'
                       WHEN 5 THEN '{S.SEND_DISABLED}' END AS error_message,
             rule <> 3 AS is_logged, TIMESTAMP '{NOW}' AS ts,
             CAST((3 + coalesce(sum(CASE WHEN rule <> 3 THEN 1 ELSE 0 END) OVER (
               PARTITION BY run_id ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) // 20
               AS INTEGER) AS send_day
      FROM r""",
}
