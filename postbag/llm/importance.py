"""Importance resampling toward a target distribution, from hashed word runs.

The texts of a batch are joined with a separator that is in no word, one pass of a pattern finds the
words of all of them, and a binary search over the texts' offsets says whose each word is. Runs that
would reach from one text into the next are masked before they are counted.
"""

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postbag.llm.common import Bounded, keep, per_worker, plain

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
CHUNK_BYTES = 8_000_000  # what is joined at once; longer texts are cut between words


def _chunks(texts: Iterable[bytes], limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """Texts, lowered and with their numbers, in lists of about ``limit`` bytes."""
    held, size = [], 0
    for number, text in enumerate(texts):
        start = 0
        while len(text) - start > limit:
            cut = GAP.search(text, start + limit)
            if cut is None:
                break
            yield [*held, (number, text[start : cut.start()])]
            held, size, start = [], 0, cut.start()
        held.append((number, text[start:]))
        size += len(text) - start
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs(texts: Iterable[bytes], n: int, buckets: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(text, bucket, length)`` of all runs of 1 to ``n`` words, by chunk and length of the run.

    The last words of a chunk are carried into the next, so that a text that was cut loses no run.
    """
    memo = per_worker("word-crc", lambda: Bounded(zlib.crc32))
    words: list[bytes] = []
    owner = np.empty(0, np.int64)
    for chunk in _chunks((t.lower() for t in texts), limit):
        offsets = np.cumsum([0] + [len(t) + 1 for _, t in chunk[:-1]])
        numbers = np.array([i for i, _ in chunk])
        carried = min(len(words), n - 1)
        words = words[len(words) - carried :]
        starts = []
        for found in WORD.finditer(b"\n".join([t for _, t in chunk])):
            words.append(found.group())
            starts.append(found.start())
        own = numbers[np.searchsorted(offsets, np.array(starts, np.int64), "right") - 1]
        owner = np.concatenate([owner[len(owner) - carried :], own])
        for k in range(1, n + 1):
            first = np.arange(max(0, carried - k + 1), len(words) - k + 1)
            first = first[owner[first] == owner[first + k - 1]]
            if k == 1:
                codes = np.fromiter(map(memo.__getitem__, words[carried:]), np.int64, len(words) - carried)
            else:
                codes = np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) for i in first.tolist()), np.int64, len(first))
            yield owner[first], codes % buckets, k


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _counted(n: int, buckets: int):
    """How often each bucket is hit in the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, codes, _ in runs(_bytes(batch.column(0)), n, buckets):
                hits += np.bincount(codes, minlength=buckets)
        filled = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(hits[filled])], ["bucket", "n"])

    return run


def noise(seed: int, identifier: object) -> int:
    """The whole thousandths of a Gumbel variate that seed and identifier decide."""
    h = int(hashlib.sha256(f"{seed}:{identifier}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(gains: np.ndarray, n: int, seed: int):
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            words, features, sums = (np.zeros(size, np.int64) for _ in range(3))
            for owner, codes, k in runs(_bytes(batch.column(1)), n, buckets):
                hits = np.bincount(owner, minlength=size)
                features += hits
                words += hits * (k == 1)
                # below 2**53 in any text, so sums in doubles are exact
                sums += np.bincount(owner, gains[codes], size).astype(np.int64)
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            score = [None if i is None else int(w) + noise(seed, i) for i, w in zip(batch.column(0).to_pylist(), weight)]
            columns = [*map(pa.array, (words, features, weight)), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_features", "weight", "score"])

    return run


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Runs per bucket over all rows of ``text``. As many numbers as there are buckets reach the driver."""
    counts = texts.select("text").mapInArrow(_counted(n, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.bucket] = row.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths: how much likelier it is in the target than in the source."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((float(y + 1) * (s + b)) / (float(x + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def _placed(scored: DataFrame, wanted: int, eligible: str) -> DataFrame:
    """``rank`` of the ``wanted`` highest scores, ties to the smaller identifier; NULL for the others.

    Scores are whole numbers and their noise spreads them, so rows are counted per score first; only
    totals of blocks of 256 scores are put in one order. Rows of one score are ordered among themselves,
    and only where some of them are drawn. Noise puts at most 0.04 % of the identifiers on one score.
    """
    per_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    per_score = keep(per_score.withColumn("block", F.shiftright("score", 8)), "importance-scores")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_score.groupBy("block").agg(F.sum("n").alias("n")).repartition(1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before.orderBy(F.desc("block"))), F.lit(0)).alias("blocks_above"))
    inside = F.sum("n").over(before.partitionBy("block").orderBy(F.desc("score")))
    above = per_score.withColumn("inside", F.coalesce(inside, F.lit(0))).join(blocks, "block")
    above = above.select("score", (F.col("blocks_above") + F.col("inside")).alias("above"))
    placed = scored.join(above, "score", "left")
    may = F.coalesce(F.expr(f"{eligible} AND above < {wanted}"), F.lit(False))
    tied = Window.partitionBy("score").orderBy("id", "n_features", "weight", "n_words")
    rank = F.col("above") + F.row_number().over(tied)
    drawn = placed.where(may).withColumn("rank", rank)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(placed.where(~may).withColumn("rank", F.lit(None).cast("long"))).drop("above")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    n: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    percent: int = 10,
    least_words: int = 20,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for each row of ``docs``.

    Texts are bags of all runs of 1 to ``n`` words, hashed into ``buckets``. A text's weight is the mean
    of the gains of its runs, its score the weight with noise from its identifier, and of the texts with
    ``least_words`` words the ``percent`` in a hundred with the highest scores are drawn, without
    replacement and in the proportions of their importance. Two passes read the texts, none keeps them.

    NULL and empty texts have no words and weight 0. A row without identifier has no noise: its score and
    rank are NULL and it is not counted among the texts to draw from. Repeated identifiers have the same
    noise and are drawn as rows of their own. An empty target or an empty table is a distribution without
    counts. Other columns are not looked at.
    """
    texts = plain(docs, id=id_col, text=text_col)
    kind = texts.schema["id"].dataType.simpleString()
    gains = gains_of(
        bucket_counts(texts, n, buckets), bucket_counts(plain(target, text=target_text), n, buckets)
    )
    scored = keep(
        texts.mapInArrow(_weighed(gains, n, seed), f"id {kind}, n_words long, n_features long, weight long, score long"),
        "importance",
    )
    eligible = f"n_words >= {least_words} AND id IS NOT NULL"
    wanted = percent * scored.where(eligible).count() // 100
    return _placed(scored, wanted, eligible).select(
        F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank"
    )


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).drop("n_words")


QUERIES = {"op13_importance": op13_importance}

_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"


def _sql_words() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_LN_SCORE = "CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT)"

SQL = {
    "op13_importance": f"""
      WITH RECURSIVE
      d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_sql_words()} AS words FROM documents),
      dw AS MATERIALIZED (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL),
      bw AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest({_sql_words()}) AS word FROM benchmark)
                          GROUP BY ALL),
      steps AS (SELECT range AS i, 0 AS step, range AS c FROM range(256)
                UNION ALL SELECT i, step + 1, {_CRC_STEP} FROM steps WHERE step < 8),
      crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE step = 8),
      spelt AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
      crcs AS (SELECT word, x, 0 AS pos, 4294967295::BIGINT AS c FROM spelt
               UNION ALL
               SELECT word, x, pos + 1,
                      xor(c // 256, t[1 + xor(c % 256, CAST('0x' || substr(x, 2 * pos + 1, 2) AS BIGINT))])
               FROM crcs, crc_table WHERE 2 * pos < length(x)),
      code AS MATERIALIZED (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crcs WHERE 2 * pos = length(x)),
      s AS (SELECT bucket, sum(n) AS s FROM dw JOIN code USING (word) GROUP BY 1),
      t AS (SELECT bucket, sum(n) AS t FROM bw JOIN code USING (word) GROUP BY 1),
      gain AS MATERIALIZED (
        SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM dw)::DOUBLE)
          / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + 10000 FROM bw)::DOUBLE))) AS BIGINT) AS gain
        FROM s FULL JOIN t USING (bucket)),
      sums AS (SELECT r, sum(n * gain) AS total FROM dw JOIN code USING (word) JOIN gain USING (bucket) GROUP BY 1),
      weighed AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features,
               CAST(CASE WHEN total IS NULL THEN 0
                         ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END AS BIGINT) AS weight,
               CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
        FROM d LEFT JOIN sums USING (r)),
      scored AS (SELECT doc_id, n_features, weight, weight + {_LN_SCORE} AS score FROM weighed),
      ranked AS (
        SELECT *, n_features >= 20 AND score IS NOT NULL AS may,
               row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place
        FROM scored)
      SELECT doc_id, n_features, weight, score,
             CASE WHEN may AND place <= 10 * (SELECT count(*) FROM ranked WHERE may) // 100 THEN place END AS rank
      FROM ranked"""
}
