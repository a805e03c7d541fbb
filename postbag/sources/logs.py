"""Run, message and setting logs, and the outbox.

Nothing is updated in place: each change is one more row, and ``latest_by_key`` reads the state.
Ids are made from what a row is about, so that a batch written twice can be told by its ids.
"""

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag import schema as S
from postbag.functions.clock import day_of
from postbag.functions.labels import as_text


def now_utc() -> Column:
    return F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
    )


def ensure_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Create the log tables that do not exist yet; path by table name."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in S.TABLES}
    for name, schema in S.TABLES.items():
        empty = spark.createDataFrame([], schema)
        if name == "messages_log":
            keyed = empty.withColumns({"batch": F.lit(""), "day": F.current_date()})
            keyed.write.mode("ignore").partitionBy("batch", "day").parquet(paths[name])
        else:
            empty.write.mode("ignore").parquet(paths[name])
    return paths


def _one_row(spark: SparkSession, schema, **values: Column | str | int | None) -> DataFrame:
    cells = []
    for field in schema.fields:
        value = values.get(field.name)
        cell = value if isinstance(value, Column) else F.lit(value)
        cells.append(cell.cast(field.dataType).alias(field.name))
    return spark.range(0, 1, 1, 1).select(*cells)


def run_row(
    spark: SparkSession,
    run_id: str,
    file_name: str | None,
    status: str,
    error_message: str | None = None,
    ts: Column | None = None,
    seq: int = 0,
) -> DataFrame:
    return _one_row(
        spark,
        S.RUNS_LOG,
        run_id=run_id,
        seq=seq,
        ts=now_utc() if ts is None else ts,
        file_name=file_name,
        status=status,
        error_message=error_message,
    )


def start_run(
    spark: SparkSession, path: str, run_id: str, file_name: str, ts: Column | None = None
) -> str:
    run_row(spark, run_id, file_name, S.RUNNING, None, ts).write.mode("append").parquet(path)
    return run_id


def end_run(
    spark: SparkSession,
    path: str,
    run_id: str,
    status: str,
    error_message: str | None = None,
    ts: Column | None = None,
    seq: int = 1,
) -> None:
    row = run_row(spark, run_id, None, status, error_message, ts, seq)
    row.write.mode("append").parquet(path)


def current_runs(runs_log: DataFrame) -> DataFrame:
    """Latest state of each run, with the start time and the file name it was started with."""
    state = [c for c in runs_log.columns if c not in ("run_id", "file_name", "seq")]
    runs = runs_log.groupBy("run_id").agg(
        F.max_by(F.struct(*state), F.struct("seq", "ts")).alias("_last"),
        F.min("ts").alias("started"),
        F.max("file_name").alias("file_name"),
    )
    return runs.select("run_id", "_last.*", "started", "file_name")


def message_id(*parts: str) -> Column:
    """The same id whenever the same row is written."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string"), F.lit("\x00")) for p in parts]), 256)


def append_messages(messages: DataFrame, path: str, batch: str | None = None) -> None:
    """Log a batch of outcomes, in a folder of its own with one folder per UTC day.

    A batch that is logged again replaces its folder, also on a later day, so that it counts once. Batches
    are known by ``batch``, the name of an attempt, or else by the ids of their messages.
    """
    rows = messages.select([f.name for f in S.MESSAGES_LOG.fields]).withColumn("day", day_of(F.col("ts")))
    if batch is None:
        known = F.sum(F.xxhash64("message_id").cast("decimal(38,0)"))
        batch = str(tuple(rows.agg(F.count("*"), known).first()))
    folder = f"{path}/batch=b{hashlib.sha256(batch.encode()).hexdigest()[:32]}"
    rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(folder)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The message log with its folders' ``day``: a plain scan, for every batch is there once."""
    days = T.StructType([*S.MESSAGES_LOG.fields, T.StructField("day", T.DateType())])
    return spark.read.schema(days).parquet(path).drop("batch")


def setting_row(
    spark: SparkSession, key: str, value, ts: Column | None = None, seq: int = 0
) -> DataFrame:
    return _one_row(
        spark,
        S.SETTINGS_LOG,
        key=key,
        value=as_text(F.lit(value)),
        ts=now_utc() if ts is None else ts,
        seq=seq,
    )


def put_setting(
    spark: SparkSession, path: str, key: str, value, ts: Column | None = None, seq: int = 0
) -> None:
    setting_row(spark, key, value, ts, seq).write.mode("append").parquet(path)


OUTBOX_MONTH = "send_month"


def write_outbox(outbox: DataFrame, path: str, mode: str = "append", days: str = "send_day") -> None:
    """Write messages to be sent, in order of their days, one folder per month.

    Spark cuts the order into ranges of like size, so that a large day has several files and small ones
    share one. A filter on the day finds its rows by what the files say of their row groups. Months are
    those of ``send_after``, or 31 days each where there is no such column.
    """
    if "send_after" in outbox.columns:
        month = F.date_format("send_after", "yyyy-MM")
    else:
        month = F.floor(F.col(days) / 31).cast("string")
    rows = outbox.withColumn(OUTBOX_MONTH, month)
    hashed = [c for c, kind in outbox.dtypes if "map<" not in kind and "variant" not in kind]
    ordered = rows.repartitionByRange(OUTBOX_MONTH, days, F.xxhash64(*hashed)).sortWithinPartitions(OUTBOX_MONTH, days)
    ordered.write.mode(mode).partitionBy(OUTBOX_MONTH).parquet(path)


def read_outbox(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, month: str | None = None
) -> DataFrame:
    """The outbox, or one ``month`` of it by its folder alone."""
    outbox = spark.read.parquet(path)
    if month is not None:
        outbox = outbox.where(F.col(OUTBOX_MONTH).cast("string") == month)
    return outbox.drop(OUTBOX_MONTH) if columns is None else outbox.select(*columns)
