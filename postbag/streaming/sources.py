"""File streams over the tables and contact files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag import schema as S
from postbag.functions.clock import utc_instant
from postbag.sources.contacts import CORRUPT, clean_contacts, csv_options, misfit
from postbag.sources.records import lines_of


def stream_table(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """New files of a parquet table, be it one file or a folder of them.

    A file stream wants a folder; the bracket makes the path a pattern, which may also name a file.
    """
    head, _, last = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).options(**options).parquet(f"{head}/[{last[0]}]{last[1:]}")


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "0 seconds", out: str | None = None) -> DataFrame:
    """UTC wall-clock column as event time; rows more than ``delay`` behind the newest are late."""
    name = out or ts
    return df.withColumn(name, utc_instant(F.col(ts))).withWatermark(name, delay)


def stream_lines(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Contact files as they are dropped into a folder, line by line, for ``load_lines``."""
    stream = spark.readStream.options(pathGlobFilter="*.csv", recursiveFileLookup="true", **options).text(folder)
    return lines_of(stream)


def stream_contacts(spark: SparkSession, folder: str, headers: list[str] | None = None) -> DataFrame:
    """Contact files as they are dropped into a folder: ``file_name``, contact fields, ``error``.

    All files have the header row ``headers``, in this order; another header stops the stream, since
    its cells would be taken for others. ``contact_sink`` takes files of any header.
    """
    names = headers or list(S.CONTACT_HEADERS)
    fields = [T.StructField(h, T.StringType()) for h in [*names, CORRUPT]]
    raw = (
        spark.readStream.schema(T.StructType(fields))
        .options(**csv_options(), enforceSchema="false", pathGlobFilter="*.csv", recursiveFileLookup="true")
        .csv(folder)
        .withColumn("file_name", F.col("_metadata.file_path"))
    )
    return clean_contacts(raw.withColumn(CORRUPT, misfit(F.col(CORRUPT), len(names))), "file_name")
