"""Stored profile pages."""

from pyspark.sql import DataFrame, SparkSession

from postbag import schema as S


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html`` of pages stored beforehand."""
    return spark.read.schema(S.PAGES).parquet(path)
