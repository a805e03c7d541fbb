"""What several operators share: kept tables, per-worker values, 64-bit mixing."""

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import workspace

keep = workspace.keep

#: Bits of a filter of keys: 8 MB at most.
FILTER_BITS = 1 << 26


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """A value that one Python worker builds once and keeps between tasks."""
    held = sys.__dict__.setdefault("_postbag_llm", {})
    if name not in held:
        held[name] = make()
    return held[name]


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """What runs inside sends Arrow batches of about ``size`` to Python, not of up to 10,000 rows of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Bounded(dict):
    """A memo of ``compute(key)`` that forgets everything at ``limit`` entries.

    Only time depends on the limit, never a result. Keys over 64 characters are not kept.
    """

    def __init__(self, compute: Callable[[Any], Any], limit: int = 300_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, start: int = 1) -> np.ndarray:
    """``n`` fixed 64-bit seeds."""
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that no other column can clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def with_filter(df: DataFrame, key: str, keys: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """Add ``flag``: false tells for certain that ``key`` is not in the column of this name of ``keys``.

    The filter has a fixed size however many keys there are, and is broadcast; ``flag`` is also true for as
    many other rows as share a bit with a key. No row of ``df`` is shuffled.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    at = keys.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    # by bucket before the bitmaps are made, else each task would pass on bitmaps of its own; 4 KB for 2^15 bits
    bitmaps = at.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    bucketed = df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmaps), "_bucket", "left")
    bucketed = bucketed.withColumn("_bit", F.bitmap_bit_position(place))
    byte = F.expr("substring(_bitmap, int(_bit div 8) + 1, 1)")
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("_bit") % 8).cast("int")) == 1
    return bucketed.select(*[df[f"`{c}`"] for c in df.columns], F.coalesce(held, F.lit(False)).alias(flag))
