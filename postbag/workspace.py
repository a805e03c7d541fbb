"""Where written tables and stream checkpoints go.

A cluster names a shared folder in ``spark.checkpoint.dir``; every written stage lands beneath it,
so that losing an executor never loses a stage. Only where the setting is absent, as in local
tests, is a temporary folder made.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="postbag-")
    return _local_root


def fresh(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path beneath the shared folder."""
    return f"{root(spark)}/postbag/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage.

    ``codec`` is how Parquet compresses it, if not as the session says.
    """
    spark = df.sparkSession
    target = path or fresh(spark, label)
    df.write.mode("overwrite").parquet(target, compression=codec)
    return spark.read.schema(df.schema).parquet(target)


class Stages:
    """Written tables that are only needed until something later is written.

    ``drop`` takes tables away that nothing unwritten reads any more; without names, all that are left.
    Only folders that this object has made are ever touched.
    """

    def __init__(self, spark: SparkSession, codec: str | None = None):
        self.spark, self.codec = spark, codec
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh(self.spark, label)
        table = keep(df, label, path, self.codec)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for table in tables or [t for t, _ in self.paths.values()]:
            _, path = self.paths.pop(id(table))
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
