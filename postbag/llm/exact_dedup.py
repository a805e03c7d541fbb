"""Exact duplicates through a stream with keyed, disk-backed state that never expires."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag import workspace
from postbag.llm.common import keep
from postbag.streaming.sources import stream_table

# State on disk; many small stores need no space set aside for their logs.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text with every run of ASCII blanks as one space; NULL is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _located(rows: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """Identifier, digest and locator (file and row in it) of each row, and its text where asked for."""
    text = normalised(rows[f"`{text_col}`"])
    held = F.struct(
        rows[f"`{id_col}`"].isNull().alias("without_id"),
        rows[f"`{id_col}`"].alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    out = rows.select(held.alias("at"), text.alias("body"))
    digest = F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest")
    return out.select(digest, "at", *(["body"] if with_text else []))


def track_duplicates(
    spark: SparkSession,
    path: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bytes_per_batch: int = 64 << 30,
) -> DataFrame:
    """Runs the stream over all files in ``path`` that ``folder`` has not seen, and returns the state.

    The state of a digest is the first row by identifier (the stable identifier), where its content
    lies, and how many rows had the digest; it lives in RocksDB and has no expiry. Rows of a batch are
    combined before the shuffle, so a digest that a third of them share is no hot spot. Running it
    again with the same ``folder`` goes on with new files. Changed states are written per batch; a
    batch that is run again overwrites its own folder, and because the identifier only falls and the
    count only grows, the latest state is a minimum and a maximum.
    """
    schema = spark.read.parquet(path).schema
    stream = stream_table(spark, path, schema, maxBytesPerTrigger=max_bytes_per_batch)
    states = (
        _located(stream, id_col, text_col, with_text=False)
        .groupBy("digest")
        .agg(F.min("at").alias("keeper"), F.count("*").alias("seen"))
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        query = (
            states.writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .foreachBatch(store)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    stored = T.StructType(states.schema.fields)
    if query.lastProgress is None and not _exists(spark, f"{folder}/states"):
        return spark.createDataFrame([], stored)
    all_states = spark.read.schema(stored).parquet(f"{folder}/states/batch=*")
    return all_states.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("seen").alias("seen"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bytes_per_batch: int = 64 << 30,
    folder: str | None = None,
) -> DataFrame:
    """One row per document of the Parquet files in ``path``, dropped ones too.

    ``doc_id``, ``keep_id`` (of the row that stays), ``group_size``, ``kept``, ``text_sha256`` and the
    locator ``file``, ``row``. Texts are equal when they are identical after :func:`normalised`. Where
    a digest is hit, the full text is compared with that at the keeper's locator; rows that have the
    digest but other bytes form groups of their own.

    NULL and empty texts are one group. Rows without identifier come last; of rows that repeat an
    identifier, the first by file and row stays, so exactly one row of a group does. An empty table
    gives no rows. Other columns, whatever their names, are not looked at.
    """
    folder = folder or workspace.fresh(spark, "exact-dedup")
    states = track_duplicates(spark, path, folder, id_col, text_col, max_bytes_per_batch)
    states = keep(states, "exact-states")
    rows = spark.read.parquet(path)
    alone = (
        _located(rows, id_col, text_col, with_text=False)
        .join(states.where("seen = 1").select("digest", "keeper"), "digest")
        .select("digest", "at", "keeper", F.lit(1).cast("long").alias("group_size"))
    )
    hits = keep(
        _located(rows, id_col, text_col, with_text=True).join(
            states.where("seen > 1").select("digest", "keeper"), "digest"
        ),
        "exact-hits",
    )
    originals = hits.where("at = keeper").select("digest", F.col("body").alias("original"))
    compared = hits.join(originals, "digest").select(
        "digest", "at", F.when(F.col("body") != F.col("original"), F.col("body")).alias("other")
    )
    groups = compared.groupBy("digest", "other").agg(F.min("at").alias("keeper"), F.count("*").alias("group_size"))
    several = (
        compared.alias("c")
        .join(groups.alias("g"), F.expr("c.digest = g.digest AND c.other <=> g.other"))
        .select("c.digest", "c.at", "g.keeper", "g.group_size")
    )
    return alone.unionByName(several).select(
        F.col("at.doc_id").alias("doc_id"),
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("at") == F.col("keeper")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("at.file").alias("file"),
        F.col("at.row").alias("row"),
    )


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(spark, f"{folder}/documents.parquet").drop("file", "row")


QUERIES = {"op3_exact_dedup": op3_exact_dedup}

SQL = {
    "op3_exact_dedup": r"""
      WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
      SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
             doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
      FROM n WINDOW w AS (PARTITION BY body)""",
}
