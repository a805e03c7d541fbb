"""From raw documents to packed training sequences: four stages over all documents.

Each stage takes what the one before it kept, written as Parquet, and all but the last return the
columns of ``documents``. Toxic documents go; boilerplate lines go from the texts; of near duplicates
one document stays; what is left is packed into windows.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm import line_dedup, minhash, packing, toxicity
from postbag.llm.common import keep, with_filter


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7, under a model learnt from the labelled ones."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on ten sites or more, and the long ones in three documents or more.

    Only documents without a line of their own stay whole; ``n_chars`` follows the text.
    """
    cleaned = line_dedup.remove_boilerplate(docs, long_documents=3, own_lines=True)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n = F.when(F.col("lines_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n)
    return cleaned.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Rows that repeat an id together with its text are one document, of which one row stays. A row without id
    is a document of its text's, behind all that have an id. Texts under one id count as one document; each
    different one stays where its document does.

    Only rows whose document may have to go, or repeats, are shuffled; a filter of a fixed size tells which,
    and what it lets through by chance is grouped and joined like the others and stays.
    """
    place = F.shiftrightunsigned(F.xxhash64("text"), 2) + (1 << 62)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), place).alias("node"), F.struct(*docs.columns).alias("doc"))
    body = F.struct(F.col("doc.text").isNull(), F.md5(F.coalesce("doc.text", F.lit("")).cast("binary")))
    marked = minhash.near_duplicates(rows.select("node", "doc.text"), id_col="node")
    gone = marked.where("NOT kept").select(F.col("doc_id").alias("node")).distinct()
    bodies = rows.select("node", body.alias("body")).groupBy("node", "body").count()
    repeated = keep(bodies.where("count > 1").select("node").distinct(), "repeated")
    flagged = with_filter(rows, "node", gone.unionAll(repeated), "flag")
    # copies combine before they are shuffled; of a node that isn't repeated each group is one row
    once = flagged.where("flag").withColumn("body", body).groupBy("node", "body").agg(F.first("doc").alias("doc"))
    # an anti-join would be taken before the filter
    once = once.join(gone.withColumn("gone", F.lit(True)), "node", "left").where("gone IS NULL")
    return flagged.where("NOT flag").select("doc.*").unionAll(once.select("doc.*")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    return packing.pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_duplicates),
    ("packing", pack),
]

#: No SQL has the trained models and the tokenizer; the tests hold word ratios and near duplicates against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
