"""Records of CSV files whose quoted cells span lines, read by many tasks.

Spark's CSV reader gives a file with such cells to one task, since nobody can tell from the middle of a
file whether a line starts a record. The number of quotes before a line tells: it is even just where a
record may start. So lines are read in blocks, blocks tell how many quotes and record starts they hold
(the latter for both cases), short totals of blocks are put in order, and each line is told what it is.
Most lines are records as they stand; only the pieces of broken ones are brought together.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postbag import workspace

BLOCK_BITS = 17  # lines of a block, also where a file can't be split
MAX_LINES = 10_000  # of one record; a quote that is never closed would make one of all that follows
UNCLOSED = "A quoted cell spans more than 10,000 lines."


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``_line, file_name, _start`` of text files, split as Spark sees fit."""
    return lines_of(spark.read.text(path))


def lines_of(texts: DataFrame) -> DataFrame:
    return texts.select(
        F.col("value").alias("_line"),
        F.col("_metadata.file_path").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def split_records(lines: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """``file_name, _rec, _record, _unclosed`` of lines in the order in which they are read.

    ``_rec`` counts a file's records from 0, the header. Breaks inside cells become line feeds; empty lines
    outside of cells are no records. Quotes are taken to stand around cells or doubled inside them. A record
    of more than ``max_lines`` lines is not put together: its lines come as they are, with ``_unclosed``.
    The lines are written once, so that what is counted and what is cut are from the same reading.
    """
    block = F.shiftright("_id", BLOCK_BITS).alias("_block")
    rows = lines.withColumn("_id", F.monotonically_increasing_id()).select("*", block)
    rows = workspace.keep(rows.withColumn("_quotes", F.length("_line") - F.length(F.replace("_line", F.lit('"')))), "lines")
    key = ["file_name", "_start", "_block"]
    in_block = Window.partitionBy(*key).orderBy("_id")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2
    filled = F.length("_line") > 0
    placed = rows.withColumn("_odd", odd).withColumns(
        {f"_s{p}": F.sum(((F.col("_odd") == p) & filled).cast("int")).over(so_far) for p in (0, 1)}
    )
    totals = rows.groupBy(*key).agg(F.sum("_quotes").alias("_quotes"))
    starts = placed.groupBy(*key).agg(F.max("_s0").alias("_n0"), F.max("_s1").alias("_n1"))
    earlier = Window.partitionBy("file_name").orderBy("_start", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.join(starts, key).withColumn("_inside", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    n = F.when(F.col("_inside") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    blocks = blocks.withColumn("_earlier", F.coalesce(F.sum(n).over(earlier), F.lit(0))).select(*key, "_inside", "_earlier")

    found = placed.join(blocks, key)
    number = F.col("_earlier") + F.when(F.col("_inside") == 0, F.col("_s0")).otherwise(F.col("_s1")) - 1
    found = found.withColumns(
        {"_rec": number, "_open": (F.col("_odd") + F.col("_inside")) % 2, "_shut": (F.col("_odd") + F.col("_inside") + F.col("_quotes")) % 2}
    )
    none = F.lit(None).cast("string").alias("_unclosed")
    whole = found.where((F.col("_open") == 0) & (F.col("_shut") == 0) & filled)
    pieces = found.where((F.col("_open") == 1) | (F.col("_shut") == 1)).select("file_name", "_rec", "_start", "_id", "_line")
    long = pieces.groupBy("file_name", "_rec").agg(F.count("*").alias("_n")).where(F.col("_n") > max_lines)
    broken = pieces.join(long, ["file_name", "_rec"], "left_anti").groupBy("file_name", "_rec").agg(
        F.array_sort(F.collect_list(F.struct("_start", "_id", "_line"))).getField("_line").alias("_lines")
    )
    endless = pieces.join(long, ["file_name", "_rec"], "left_semi")
    return (
        whole.select("file_name", "_rec", F.col("_line").alias("_record"), none)
        .unionByName(broken.select("file_name", "_rec", F.array_join("_lines", "\n").alias("_record"), none))
        .unionByName(endless.select("file_name", "_rec", F.col("_line").alias("_record"), F.lit(UNCLOSED).alias("_unclosed")))
    )
