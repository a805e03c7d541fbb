"""Near duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``t`` coordinates. In each of the first ``t`` rounds every shingle is thrown into a bin
by a hash of that round; in round ``t + i`` all are thrown into bin ``i``. A bin keeps the smallest
value of the first round that reached it, so after ``2 t`` rounds no coordinate is empty, and the share
of equal coordinates is concentrated around the similarity as for ``t`` independent hash functions.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import Bounded, keep, mix, per_worker, plain, seeds
from postbag.llm.components import components
from postbag.workspace import Stages

FOLD = np.uint64(0x100000001B3)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD_BITS = 2048


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles of ``width`` words.

    Words are runs of non-blank characters with A-Z lowered; a text of fewer words is one shingle, and
    without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    memo = per_worker("word-hashes", lambda: Bounded(xxhash.xxh3_64_intdigest))
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * FOLD + h[k : k + n])
    return np.unique(out)


def sketch(x: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a non-empty set of 64-bit hashes; none of them stays empty."""
    out = np.full(t, NONE)
    keys = seeds(2 * t)
    for r in range(2 * t):
        v = mix(x ^ keys[r])
        low, high = v & np.uint64(0xFFFFFFFF), v >> np.uint64(32)
        if r < t:
            least = np.full(t, NONE)
            np.minimum.at(least, ((low * np.uint64(t)) >> np.uint64(32)).astype(np.intp), high)
            new = (out == NONE) & (least != NONE)
            out[new] = least[new] | np.uint64(r << 32)
            if (out != NONE).all():
                break
        elif out[r - t] == NONE:
            out[r - t] = high.min() | np.uint64(r << 32)
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; keys of different bands differ as well."""
    groups = coordinates.reshape(-1, rows)
    out = seeds(len(groups), 1 << 20)
    for k in range(rows):
        out = mix(out * FOLD + groups[:, k])
    return out


def odd_bits(x: np.ndarray) -> np.ndarray:
    """The odd sketch of a set: bit ``i`` tells whether an odd number of its hashes fall on ``i``.

    Each bit in which two sketches differ needs an element that only one of the sets has, so the number
    of such bits is never above the size of the symmetric difference.
    """
    hit = np.bincount((mix(x) % np.uint64(ODD_BITS)).astype(np.intp), minlength=ODD_BITS) & 1
    return np.packbits(hit.astype(np.uint8)).view(np.int64)


def _sketched(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, found, parts, odd = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                x = shingles(text, width)
                sizes.append(len(x))
                if len(x):
                    coordinates = sketch(x, bands * rows)
                    keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                    found.append(band_keys(coordinates, rows).view(np.int64))
                    parts.append(mix(coordinates).astype(np.uint16).view(np.int16))
                    odd.append(odd_bits(x))
                else:
                    keys.append(None)
                    found.append(None)
                    parts.append(None)
                    odd.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(found, pa.list_(pa.int64())),
                    pa.array(parts, pa.list_(pa.int16())),
                    pa.array(odd, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "parts", "odd"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, len(texts), 500):
                part = texts.slice(start, 500).to_pylist()
                sets = [shingles(x, width).view(np.int64) for x in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, 500), pa.array(sets, pa.list_(pa.int64()))], ["node", "members"]
                )

    return run


def _close(a: str, b: str, percent: int) -> Column:
    """Sizes that a similarity of ``percent`` allows."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _alike(percent: int, t: int) -> Column:
    """So many equal coordinates that the similarity may be reached: five deviations below it."""
    p = percent / 100
    least = max(0, int(t * p - 5 * (t * p * (1 - p)) ** 0.5))
    return F.expr(f"size(filter(zip_with(l.parts, r.parts, (x, y) -> x = y), z -> z)) >= {least}")


def _few_apart(percent: int) -> Column:
    """Odd sketches that allow a similarity of ``percent``; no pair that reaches it is ever ruled out."""
    differ = "aggregate(zip_with(l.odd, r.odd, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return F.expr(f"{100 + percent} * {differ} <= {100 - percent} * (l.n_shingles + r.n_shingles)")


def _whole_sets(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, stages: Stages) -> DataFrame:
    """``node``, ``members``: the whole shingle set of each node in ``pairs``.

    The nodes are written first, so that Spark knows how few they are before it moves any text.
    """
    involved = stages.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "minhash-involved")
    rows = texts.join(involved, "doc_id", "left_semi")
    sets = rows.mapInArrow(_sets(width), "node long, members array<long>")
    # where rows repeat an identifier, the set of the node is the one that was sketched
    sets = sets.join(nodes.selectExpr("node", "n_shingles n"), "node").where("size(members) = n").drop("n")
    sets = stages.keep(sets, "minhash-sets")
    stages.drop(involved)
    return sets


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` with the size of the intersection and of the union of their whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ma", "mb")))
    return both.select("a", "b", "common", (F.size("ma") + F.size("mb") - F.col("common")).alias("all"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 4,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    Documents are linked when their sets of ``width``-word shingles have a similarity of ``percent`` or
    more. Equal sets become one node first. In each bucket of a band the member that meets most others
    is compared with all of them: as many pairs as members. Then members of a bucket that are still
    in different components are compared with each other, in the first band they share and unless
    sizes, sketches or their distances from that member rule the link out, so no pair of a bucket is left
    undecided and none inside a component is spelled out. Odd sketches rule out without error what
    differs too much; so few pairs beyond the links are left, even in large groups of texts that are
    nearly near. At a similarity of exactly 0.8 a pair shares no band with a probability of 3e-6. Links are confirmed
    on whole sets.

    NULL, empty and blank texts have an empty set and are linked with nothing. Rows without identifier
    keep ``component_id`` NULL and ``kept`` true. Rows that repeat an identifier count as one document.
    An empty table gives no rows; other columns are not looked at.
    """
    texts = plain(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    stages = Stages(docs.sparkSession)
    sketches = stages.keep(
        texts.mapInArrow(
            _sketched(width, bands, rows),
            "doc_id long, n_shingles long, set_key binary, bands array<long>, parts array<short>, odd array<long>",
        ),
        "minhash-sketches",
    )
    filled = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stages.keep(filled.groupBy("set_key").agg(F.min("doc_id").alias("node")), "minhash-classes")
    named = stages.keep(
        filled.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "node").distinct(), "minhash-named"
    )
    nodes = filled.join(classes.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    nodes = nodes.withColumnRenamed("doc_id", "node")
    postings = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = stages.keep(postings.join(shared, "key"), "minhash-crowded")
    # the member that meets most others over all its bands is the likeliest centre of a group
    central = crowded.groupBy("node").agg(F.sum("n").alias("meets"))
    buckets = stages.keep(crowded.join(central, "node").select("key", "band", "node", "meets"), "minhash-buckets")
    stages.drop(crowded)
    centre = F.max(F.struct("meets", F.xxhash64("node", "key").alias("h"), "node")).getField("node")
    pivots = buckets.groupBy("key").agg(centre.alias("pivot"))
    pairs = buckets.join(pivots, "key").where("node <> pivot")
    stars = stages.keep(
        pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "minhash-stars"
    )
    own = named.where("doc_id <> node").selectExpr("doc_id a", "node b")
    sets = _whole_sets(stars, nodes, texts, width, stages)
    linked = f"100 * common >= {percent} * all"
    measured = stages.keep(_measured(stars, sets), "minhash-measured")
    links = measured.where(linked).select("a", "b")
    first = components(links, "minhash-first", stages)

    # distances (1 less the similarity) obey the triangle inequality: members that are not equally far
    # from their pivot can't be near each other
    around = pairs.select("key", "band", "node", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    around = around.join(measured, ["a", "b"]).select("key", "band", "node", (F.col("common") / F.col("all")).alias("near"))
    centres = buckets.join(pivots.withColumnRenamed("pivot", "node"), ["key", "node"], "left_semi")
    around = around.unionByName(centres.select("key", "band", "node", F.lit(1.0).alias("near")))
    placed = around.join(first, "node", "left").select("key", "band", "near", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    traits = nodes.select("node", "n_shingles", "bands", "parts", "odd")
    apart = stages.keep(placed.join(mixed.select("key"), "key").join(traits, "node"), "minhash-apart")
    stages.drop(buckets)
    rest = apart.alias("l").join(
        apart.alias("r"),
        (F.col("l.key") == F.col("r.key"))
        & (F.col("l.node") < F.col("r.node"))
        & (F.col("l.component") != F.col("r.component"))
        & _close("l.n_shingles", "r.n_shingles", percent)
        & F.expr("array_position(zip_with(l.bands, r.bands, (x, y) -> x = y), true) = l.band + 1")
        & (F.abs(F.col("l.near") - F.col("r.near")) <= 1 - percent / 100 + 1e-9)
        & _few_apart(percent)
        & _alike(percent, bands * rows),
    )
    rest = stages.keep(rest.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct(), "minhash-rest")
    stages.drop(apart)
    more = _measured(rest.join(stars, ["a", "b"], "left_anti"), sets).where(linked).select("a", "b")
    edges = first.selectExpr("node a", "component b").unionAll(more).unionAll(own)
    final = components(edges, "minhash-final", stages)
    out = (
        sketches.select("doc_id", "n_shingles")
        .join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            (F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        )
    )
    out = keep(out, "minhash")
    stages.drop()
    return out


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), width=2)


QUERIES = {"op4_minhash": op4_minhash}

SQL: dict[str, str] = {}
