"""Contact files, addresses and defaults."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.functions.labels import int_or_default, label_channel
from postbag.functions.text import default_if_blank, slugify, split_last
from postbag.operators.addresses import resolve_address, with_address
from postbag.operators.drafts import DEFAULT_USER_PROMPT
from postbag.operators.outcomes import isolate_errors
from postbag.operators.quota import plan_days, row_count
from postbag.plans.tables import (
    SQL_EVENT_NUMBER,
    event_number,
    sql_slug,
    sql_strip,
    sql_text,
    table,
)
from postbag.sources.contacts import load_each, read_contacts, read_split_contacts
from postbag.sources.logs import message_id
from postbag.streaming.sinks import append_sink, contact_sink, read_contact_sink, run_to_end
from postbag.streaming.sources import stream_contacts


def customer_contacts(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Customers as contacts of one run per market segment; those in debt have given an address."""
    name = F.col("c_name")
    return table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("run_id"),
        F.col("c_custkey").alias("row_pos"),
        name.alias("profile_url"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lower(name), F.lit("@mail.example"))).alias("email"),
        F.lit("Zoë").alias("first_name"),
        split_last(name, "#").alias("last_name"),
        F.concat_ws(" & ", "c_mktsegment", F.lit("Söhne, Inc.")).alias("company"),
        *keep,
    )


SQL_CONTACTS = """
  SELECT c_mktsegment AS run_id, c_custkey AS row_pos, c_name AS profile_url,
         CASE WHEN c_acctbal < 0 THEN lower(c_name) || '@mail.example' END AS email,
         'Zoë' AS first_name, split_part(c_name, '#', -1) AS last_name,
         c_mktsegment || ' & ' || 'Söhne, Inc.' AS company
  FROM customer"""

SQL_INFERRED = (
    "lower(first_name) || '.' || lower(last_name) || '@' || " + sql_slug("company") + " || '.com'"
)


def contact_slug(spark: SparkSession, folder: str) -> DataFrame:
    company = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return table(spark, folder, "part").select("p_partkey", slugify(company).alias("slug"))


def text_slug(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", slugify(F.col("text")).alias("slug"))


def resolved_address(spark: SparkSession, folder: str) -> DataFrame:
    on_file = table(spark, folder, "supplier").select(
        F.concat(F.lit("Customer#"), split_last(F.col("s_name"), "#")).alias("profile_url"),
        F.concat(F.lit("office@"), slugify(F.col("s_name")), F.lit(".example")).alias("on_file"),
    )
    resolved = resolve_address(customer_contacts(spark, folder), on_file)
    return resolved.select("row_pos", "profile_url", "address", "address_source")


def blank_defaults(spark: SparkSession, folder: str) -> DataFrame:
    typed = F.when(F.col("role") == "user", F.concat(F.lit(" \n\u00a0"), "text", F.lit("\t "))).otherwise(" \n\t ")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", default_if_blank(typed, DEFAULT_USER_PROMPT).alias("prompt")
    )


def channel_label(spark: SparkSession, folder: str) -> DataFrame:
    shown = (
        F.when(F.col("event_type") == "click", "\n Send immediately via InMail ")
        .when(F.col("event_type") == "purchase", " Send immediately via Email")
        .when(F.col("event_type") == "error", "Send immediately via Email or Send immediately via InMail")
        .otherwise("Send immediately")
    )
    text = F.concat(shown, F.col("props"))
    return table(spark, folder, "events").select("event_id", label_channel(text).alias("channel"))


def isolated_errors(spark: SparkSession, folder: str) -> DataFrame:
    cell = F.when(F.col("event_type") == "error", F.col("props")).otherwise(event_number().cast("string"))
    rows = table(spark, folder, "events").select(
        "event_id",
        cell.try_cast("int").alias("number"),
        int_or_default(cell, S.DEFAULT_DAILY_LIMIT).alias("number_or_default"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("body"),
    )
    failed = isolate_errors(rows, {"Not a number.": F.col("number").isNull()})
    return failed.withColumn("status", F.when(F.col("error").isNull(), S.READY).otherwise(S.FAILED))


def _awkward_file(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """Customers as a contact file: line breaks, quotes and commas in cells, missing values spelt out."""
    missing = F.element_at(
        F.array(*[F.lit(t) for t in S.NA_TOKENS]), F.col("c_nationkey") % F.lit(len(S.NA_TOKENS)) + 1
    )
    return customer_contacts(spark, folder, "c_mktsegment", "c_nationkey", *keep).select(
        *keep,
        F.col("profile_url").alias("Person Linkedin Url"),
        F.coalesce("email", missing).alias("Email"),
        F.col("first_name").alias("First Name"),
        F.col("last_name").alias("Last Name"),
        F.concat(F.lit('"'), "c_mktsegment", F.lit('",\nDépôt '), "last_name").alias("Company"),
    )


def _write_csv(rows: DataFrame, path: str) -> str:
    rows.write.options(header="true", quoteAll="true", escape='"').csv(path)
    return path


SQL_FILE = (
    """
  SELECT profile_url, email, first_name, last_name,
         '"' || run_id || '",' || chr(10) || 'Dépôt ' || last_name AS company
  FROM ("""
    + SQL_CONTACTS
    + ")"
)


def contact_file_checks(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_csv(_awkward_file(spark, folder), workspace.fresh(spark, "contacts"))
    contacts = with_address(read_contacts(spark, path))
    return contacts.select(
        "profile_url", "email", "first_name", "last_name", "company", "address", "address_is_inferred", "error"
    )


def streamed_contacts(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_csv(_awkward_file(spark, folder), workspace.fresh(spark, "contacts"))
    out = workspace.fresh(spark, "streamed-contacts")
    stream = stream_contacts(spark, path)
    run_to_end(append_sink(stream, out, out + "-checkpoint"))
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.select("profile_url", "email", "first_name", "last_name", "company", "error")


def _mixed_files(spark: SparkSession, folder: str) -> str:
    """Customers in files of three layouts: the usual one, another order with a column more, two columns less."""
    path = workspace.fresh(spark, "mixed-contacts")
    rows = _awkward_file(spark, folder, "c_custkey")
    usual = [c for c in rows.columns if c != "c_custkey"]
    kinds = {
        "a": usual,
        "b": [*reversed(usual), F.lit("x, y").alias("Note")],
        "c": [c for c in usual if c not in ("First Name", "Company")],
    }
    for k, (name, columns) in enumerate(kinds.items()):
        part = rows.where(F.col("c_custkey") % 3 == k).orderBy("c_custkey")
        _write_csv(part.select(*columns), f"{path}/{name}")
    return path


def campaign_files(spark: SparkSession, folder: str) -> DataFrame:
    """One run over all files: positions, days under the limit and message ids."""
    contacts = read_contacts(spark, _mixed_files(spark, folder) + "/*").withColumn("run_id", F.lit("spring"))
    planned = plan_days(contacts, 50, 7, dense=True)
    return planned.select(
        "row_pos", "send_day", message_id("run_id", "row_pos").alias("message_id"),
        "profile_url", "email", "first_name", "last_name", "company", "error",
    )


def rejected_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each file judged alone: contacts accepted by folder, and the state of its files in the run log."""
    path = _mixed_files(spark, folder)
    _write_csv(_awkward_file(spark, folder).drop("Person Linkedin Url"), f"{path}/d")
    contacts, runs = load_each(spark, f"{path}/*", F.lit("2024-01-15 03:30:00").cast("timestamp_ntz"))
    runs = runs.withColumn("folder", F.element_at(F.split("file_name", "/"), -2))
    per_file = contacts.groupBy("run_id").agg(F.count("*").alias("n"), (F.max("row_pos") + 1).alias("positions"))
    return (
        runs.join(per_file, "run_id", "left")
        .groupBy("folder", "status", "error_message", "ts")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("contacts"), F.coalesce(F.sum("positions"), F.lit(0)).alias("positions"))
    )


def split_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """One file with line breaks in its cells, whose blocks are read by as many tasks as it has."""
    path = workspace.fresh(spark, "one-file")
    _write_csv(_awkward_file(spark, folder, "c_custkey").coalesce(1).sortWithinPartitions("c_custkey").drop("c_custkey"), path)
    return read_split_contacts(spark, path).drop("file_name")


def stream_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Files of three layouts and rejected ones dropped in three goes: what each folder has in the run log."""
    ts = F.lit("2024-01-15 03:30:00").cast("timestamp_ntz")
    inbox, out = workspace.fresh(spark, "inbox"), workspace.fresh(spark, "mixed-stream")
    rows = _awkward_file(spark, folder, "c_custkey")
    usual = [c for c in rows.columns if c != "c_custkey"]
    layouts = {"a": usual, "b": [*reversed(usual), F.lit("x, y").alias("Note")], "c": ["Email", usual[0]], "d": usual[1:]}
    for goes in ("ad", "b", "c"):
        for name in goes:
            part = rows.where(F.col("c_custkey") % 4 == ord(name) - ord("a"))
            _write_csv(part.select(*layouts[name]), f"{inbox}/{name}")
        run_to_end(contact_sink(spark, inbox, out, out + "-checkpoint", ts))
    contacts, runs = read_contact_sink(spark, out)
    runs = runs.withColumn("folder", F.element_at(F.split("file_name", "/"), -2))
    per_file = contacts.groupBy("run_id").agg(
        F.count("profile_url").alias("n"), F.count("email").alias("m"), F.count("company").alias("k")
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "profiles"), ("m", "emails"), ("k", "companies"))]
    return runs.join(per_file, "run_id", "left").groupBy("folder", "status", "error_message", "ts").agg(*sums)


def contact_rows(spark: SparkSession, folder: str) -> DataFrame:
    return row_count(customer_contacts(spark, folder))


QUERIES = {
    "contact_slug": contact_slug,
    "text_slug": text_slug,
    "resolved_address": resolved_address,
    "blank_defaults": blank_defaults,
    "channel_label": channel_label,
    "isolated_errors": isolated_errors,
    "contact_file_checks": contact_file_checks,
    "stream_contacts": streamed_contacts,
    "contact_rows": contact_rows,
    "campaign_files": campaign_files,
    "rejected_files": rejected_files,
    "split_contacts": split_contacts,
    "stream_mixed": stream_mixed,
}

SQL = {
    "contact_slug": f"SELECT p_partkey, {sql_slug("p_name || ' ' || p_brand || ' ' || p_type")} AS slug FROM part",
    "text_slug": f"SELECT doc_id, {sql_slug('text')} AS slug FROM documents",
    "resolved_address": f"""
      WITH contacts AS ({SQL_CONTACTS}),
      on_file AS (SELECT 'Customer#' || split_part(s_name, '#', -1) AS profile_url,
                         'office@' || {sql_slug('s_name')} || '.example' AS on_file FROM supplier)
      SELECT row_pos, profile_url, coalesce(on_file, email, {SQL_INFERRED}) AS address,
             CASE WHEN on_file IS NOT NULL THEN 'on_file' WHEN email IS NOT NULL THEN 'supplied'
                  WHEN {SQL_INFERRED} IS NOT NULL THEN 'inferred' END AS address_source
      FROM contacts LEFT JOIN on_file USING (profile_url)""",
    "blank_defaults": f"""
      WITH typed AS (
        SELECT conv_id, turn, CASE WHEN role = 'user' THEN ' ' || chr(10) || chr(160) || text || chr(9) || ' '
                                   ELSE ' ' || chr(10) || chr(9) || ' ' END AS typed FROM conversations)
      SELECT conv_id, turn, coalesce(nullif({sql_strip('typed')}, ''), {sql_text(DEFAULT_USER_PROMPT)}) AS prompt
      FROM typed""",
    "channel_label": """
      WITH shown AS (
        SELECT event_id, CASE event_type
            WHEN 'click' THEN 'Send immediately via InMail ' WHEN 'purchase' THEN 'Send immediately via Email'
            WHEN 'error' THEN 'Send immediately via Email or Send immediately via InMail'
            ELSE 'Send immediately' END || props AS text FROM events)
      SELECT event_id, CASE WHEN contains(text, 'Send immediately via InMail') THEN 'InMail'
                            WHEN contains(text, 'Send immediately via Email') THEN 'Email'
                            ELSE 'unknown' END AS channel FROM shown""",
    "isolated_errors": f"""
      WITH cells AS (
        SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE {SQL_EVENT_NUMBER} END AS number
        FROM events)
      SELECT event_id, number, coalesce(number, {S.DEFAULT_DAILY_LIMIT}) AS number_or_default,
             CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS body,
             CASE WHEN number IS NULL THEN 'Not a number.' END AS error,
             CASE WHEN number IS NULL THEN '{S.FAILED}' ELSE '{S.READY}' END AS status
      FROM cells""",
    "contact_file_checks": f"""
      WITH contacts AS ({SQL_FILE})
      SELECT profile_url, email, first_name, last_name, company, coalesce(email, {SQL_INFERRED}) AS address,
             email IS NULL AS address_is_inferred, CAST(NULL AS VARCHAR) AS error FROM contacts""",
    "stream_contacts": f"""
      SELECT profile_url, email, first_name, last_name, company, CAST(NULL AS VARCHAR) AS error
      FROM ({SQL_FILE})""",
    "contact_rows": 'SELECT count(*) AS "rows" FROM customer',
    "campaign_files": f"""
      WITH placed AS (
        SELECT c_name, c_custkey % 3 AS kind,
               row_number() OVER (ORDER BY c_custkey % 3, c_custkey) - 1 AS row_pos FROM customer),
      contacts AS ({SQL_FILE})
      SELECT row_pos, CAST((7 + row_pos) // 50 AS INTEGER) AS send_day,
             sha256('spring' || chr(31) || row_pos) AS message_id, profile_url, email,
             CASE WHEN kind <> 2 THEN first_name END AS first_name, last_name,
             CASE WHEN kind <> 2 THEN company END AS company, CAST(NULL AS VARCHAR) AS error
      FROM contacts JOIN placed ON c_name = profile_url""",
    "split_contacts": f"""
      SELECT row_number() OVER (ORDER BY profile_url) - 1 AS row_pos, profile_url, email, first_name, last_name, company,
             CAST(NULL AS VARCHAR) AS error FROM ({SQL_FILE})""",
    "stream_mixed": f"""
      WITH f AS (SELECT c_custkey % 4 AS kind, f.* FROM ({SQL_FILE}) f JOIN customer ON c_name = profile_url)
      SELECT substr('abc', CAST(kind + 1 AS INTEGER), 1) AS folder, '{S.RUNNING}' AS status,
             CAST(NULL AS VARCHAR) AS error_message, TIMESTAMP '2024-01-15 03:30:00' AS ts,
             count(*) AS profiles, count(email) AS emails, count(CASE WHEN kind <> 2 THEN company END) AS companies
      FROM f WHERE kind < 3 GROUP BY ALL
      UNION ALL
      SELECT 'd', '{S.ERROR}', '{S.MISSING_COLUMNS}', TIMESTAMP '2024-01-15 03:30:00', 0, 0, 0""",
    "rejected_files": f"""
      SELECT substr('abc', CAST(c_custkey % 3 + 1 AS INTEGER), 1) AS folder, '{S.RUNNING}' AS status,
             CAST(NULL AS VARCHAR) AS error_message, TIMESTAMP '2024-01-15 03:30:00' AS ts,
             count(*) AS contacts, count(*) AS positions FROM customer GROUP BY ALL
      UNION ALL
      SELECT 'd', '{S.ERROR}', '{S.MISSING_COLUMNS}', TIMESTAMP '2024-01-15 03:30:00', 0, 0""",
}
