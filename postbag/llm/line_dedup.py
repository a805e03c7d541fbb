"""Removal of lines that are spread over many sites, by sketches and exact counts near the threshold."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import keep


def _key(line: Column) -> Column:
    """What makes lines equal: their characters without spaces around them, as a digest."""
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(lines: DataFrame, min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """``key`` of each line that is on ``min_sites`` sites or more; ``lines`` has ``key``, ``site``.

    A sketch per line is merged over tasks, and what it says is taken where it is further from the
    threshold than four of its standard errors and one site; lines nearer than that are counted exactly.
    """
    band = 4 * 1.04 / (1 << lg_k) ** 0.5 * min_sites + 1
    spread = keep(
        lines.groupBy("key")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
        .where(F.col("sites") >= min_sites - band),
        "line-spread",
    )
    sure = spread.where(F.col("sites") > min_sites + band).select("key")
    near = spread.where(F.col("sites") <= min_sites + band).select("key")
    exact = lines.join(near, "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("sites"))
    return sure.unionAll(exact.where(F.col("sites") >= min_sites).select("key"))


def remove_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 10,
    lg_k: int = 12,
    long_documents: int | None = None,
    own_lines: bool = False,
) -> DataFrame:
    """``docs`` without boilerplate in their texts, and two more columns: ``n_lines``, ``lines_removed``.

    A line is boilerplate when it is on ``min_sites`` sites or more. The first by identifier and
    position stays, the others go. A document of which more than half (in characters) would go is a
    copy rather than a page with boilerplate: it stays whole, for the dedup of documents to decide. With
    ``own_lines`` only a document that would keep no line is such a copy.

    With ``long_documents``, a line of over 50 words or 300 characters is boilerplate also when it is in
    that many documents or more, on whatever sites. Rows with the same identifier and text are one.

    Blank lines are never boilerplate. A NULL site is a site of its own. NULL texts stay NULL and have
    no lines; an empty one has one. Rows without identifier come last in order; rows that are repeated
    are treated alike. An empty table gives no rows. Columns named ``n_lines`` or ``lines_removed`` are
    replaced, all others are kept, whatever their names.
    """
    text = docs[f"`{text_col}`"]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        docs[f"`{id_col}`"].alias("id"),
        text.alias("text"),
        F.coalesce(docs[f"`{site_col}`"].cast("string"), F.lit("")).alias("site"),
    )
    # digests come before lines: beside them each would be taken once a line
    bodies = rows.select("id", F.md5(F.col("text").cast("binary")).alias("body"), "site", "text")
    at = bodies.select("id", "body", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    at = at.where(F.trim("line") != "")
    at = at.withColumn("key", _key(F.col("line")))
    found = keep(boilerplate(at.select("key", "site"), min_sites, lg_k), "boilerplate")
    if long_documents is not None:
        long = (F.length("line") > 300) | (F.size(F.split(F.trim("line"), r"\s+")) > 50)
        passages = at.where((F.length("line") > 100) & long)
        within = F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("")), "body").alias("site")
        spread = boilerplate(passages.select("key", within), long_documents, lg_k)
        found = keep(found.unionAll(spread).distinct(), "boilerplate-long")
    hits = keep(
        at.join(found, "key").select("key", "id", "body", "pos", F.length("line").alias("chars")), "boilerplate-lines"
    )
    place = F.struct(F.col("id").isNull().alias("without_id"), "id", "pos", "body")
    first = hits.groupBy("key").agg(F.min(place).alias("first"))
    gone = (
        hits.join(first, "key")
        .where(place != F.col("first"))
        .select("id", "body", "pos", "chars")
        .distinct()
        .groupBy("id", "body")
        .agg(F.collect_set("pos").alias("gone"), F.sum("chars").alias("chars"))
    )
    joined = rows.withColumn("body", F.md5(F.col("text").cast("binary"))).alias("r").join(
        gone.alias("g"), F.expr("r.id <=> g.id AND r.body = g.body"), "left"
    )
    # each step on columns of the one before, so that no text is split once a line
    joined = joined.select("r.doc", "r.text", "g.gone", "g.chars", F.split("r.text", "\n").alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    joined = joined.withColumn("places", F.when(F.col("gone").isNotNull(), places))
    joined = joined.withColumn("own", F.transform("places", lambda i: F.get("lines", i)))
    total = F.length("text") - F.size("lines") + 1
    page = F.exists("own", lambda x: F.trim(x) != "") if own_lines else 2 * F.col("chars") <= total
    cut = F.col("chars").isNotNull() & page
    left = F.array_join("own", "\n")
    kept = [c for c in docs.columns if c not in ("n_lines", "lines_removed", text_col)]
    columns = {c: F.col("doc").getField(c) for c in kept}
    columns[text_col] = F.when(cut, left).otherwise(F.col("text"))
    return joined.select(
        *[columns[c].alias(c) for c in docs.columns if c in columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(cut, F.size("gone")).otherwise(0).cast("long").alias("lines_removed"),
    )


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = remove_boilerplate(docs, long_documents=3, own_lines=True)
    return out.select("doc_id", "n_lines", "lines_removed", "text")


QUERIES = {"op9_line_dedup": op9_line_dedup}

CLEAN_SQL = """
  split_lines AS (
    SELECT doc_id, source, text, md5(text) AS body, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs}),
  keyed AS (
    SELECT *, trim(line) AS key, length(line) > 300 OR length(line) > 100
             AND len(string_split_regex(trim(line), '[ \\t\\n\\x0B\\f\\r]+')) > 50 AS long
    FROM split_lines WHERE trim(line) <> ''),
  spread AS (
    SELECT key FROM keyed GROUP BY 1
    HAVING count(DISTINCT coalesce(source, '')) >= 10 OR count(DISTINCT (doc_id, body)) FILTER (WHERE long) >= 3),
  ordered_lines AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, pos) > 1 AS gone
    FROM keyed JOIN spread USING (key)),
  cut AS (SELECT doc_id, list(pos) AS gone FROM ordered_lines WHERE gone GROUP BY doc_id),
  cleaned AS (
    SELECT d.*, coalesce(len(string_split(text, chr(10))), 0) AS n_lines,
           c.gone IS NOT NULL AND len([x FOR x, i IN string_split(text, chr(10))
             IF trim(x) <> '' AND NOT list_contains(c.gone, i - 1)]) > 0 AS has_cut,
           c.gone AS gone
    FROM {docs} d LEFT JOIN cut c USING (doc_id)),
  line_dedup AS (
    SELECT * EXCLUDE (text, gone, has_cut),
           CASE WHEN has_cut THEN len(gone) ELSE 0 END AS lines_removed,
           CASE WHEN has_cut THEN array_to_string(
             [x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(gone, i - 1)], chr(10))
           ELSE text END AS text
    FROM cleaned)"""

SQL = {
    "op9_line_dedup": f"WITH {CLEAN_SQL.format(docs='documents')}"
    " SELECT doc_id, n_lines, lines_removed, text FROM line_dedup"
}
