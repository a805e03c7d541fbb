"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Two vectors of a cosine of at least the threshold are close in every projection. Several leading
projections at once cut the vectors into small cells, in many tables with cells of their own, so that a
pair at the threshold shares a cell of some table. In a cell, a further projection is sorted, each vector
is the centre of a window on it, and for the pairs in a window collisions are counted over the other
projections; a pair with enough is verified. How many tables and how many collisions are enough is
calibrated on the distribution of a pair that lies exactly at the threshold.
"""

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, erf, exp, log, log1p, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import keep, mix, plain, seeds
from postbag.llm.components import components

WINDOW = 2.0  # half a window, in standard deviations of a projected difference at the threshold
LEAD = 5.0  # the same for the sorted projection, whose windows name the pairs that are counted
CELL = 7.5  # width of a cell on a leading projection, in the same unit
MISS = 1e-5  # share of the pairs at the threshold that share no cell of any table
UNLIKE = 0.2  # unlike vectors of the same label that a vector may expect in its cell
CHUNK = 1 << 20  # pairs looked at together


def enough(projections: int, miss: float = 1e-7) -> int:
    """The largest count that a pair at the threshold misses with a probability of at most ``miss``."""
    p = erf(WINDOW / sqrt(2))
    below, count = 0.0, 0
    while count < projections:
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            break
        count += 1
    return count


def directions(dimension: int, projections: int) -> np.ndarray:
    """Fixed Gaussian directions; the first is the one that is sorted."""
    return np.random.default_rng(7).standard_normal((dimension, projections + 1))


def _meet(width: float, spread: float) -> float:
    """Chance of one cell for two values whose difference is normal with deviation ``spread``; cells start anywhere."""
    return erf(width / spread / sqrt(2)) - spread / width * sqrt(2 / pi) * (1 - exp(-((width / spread) ** 2) / 2))


def layout(nodes: int, threshold: float) -> tuple[float, int, int]:
    """Width of cells, leading projections per table, and tables.

    So many projections that a vector shares its cell with ``UNLIKE`` of ``nodes`` unlike ones at most, then so
    many tables that a pair at the threshold shares none with a chance of ``MISS`` at most.
    """
    spread = max(sqrt(max(2 - 2 * threshold, 0)), 1e-6)
    width = min(CELL * spread, 2.0)
    depth = max(4, ceil(log(max(nodes, 2) / UNLIKE) / -log(_meet(width, sqrt(2)))))
    return width, depth, ceil(log(MISS) / log1p(-(_meet(width, spread) ** depth)))


@lru_cache(8)
def _leads(dimension: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return np.round(r.standard_normal((dimension, count)) * (1 << 16)), r.random(count)


def cell_keys(units: np.ndarray, width: float, depth: int, tables: int) -> np.ndarray:
    """A 64-bit key of each unit vector's cell in each table.

    Vectors and directions are rounded so that every sum is exact, whatever the order of its terms: a
    vector has the same keys wherever they are worked out.
    """
    if len(units) > 1000:
        return np.concatenate([cell_keys(units[k : k + 1000], width, depth, tables) for k in range(0, len(units), 1000)])
    lead, start = _leads(units.shape[1], depth * tables)
    cells = np.floor(np.round(units * (1 << 20)) @ lead / (width * (1 << 36)) + start).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(units), tables, depth)
    keys = np.broadcast_to(seeds(tables), (len(units), tables))
    for k in range(depth):
        keys = mix(keys ^ cells[:, :, k])
    return keys.view(np.int64)


def _units():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, dims, data = [], [], [], []
            for i, label, values in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if label is None or i is None or not values or None in values:
                    continue
                x = np.array(values, np.float64)
                norm = np.linalg.norm(x / (top if (top := np.abs(x).max()) > 0 else 1))
                if not (np.isfinite(x).all() and norm > 0):
                    continue
                x = x / top / norm
                ids.append(i)
                labels.append(label)
                dims.append(len(x))
                data.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(labels, pa.string()),
                    pa.array(dims, pa.int32()),
                    pa.array(data, pa.binary()),
                ],
                ["vec_id", "label", "dim", "unit"],
            )

    return run


def _keyed(width: float, depth: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                units = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(-1, dim)
                keys = cell_keys(units, width, depth, tables)
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * tables)
                lists = pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], part.column(0), lists], ["node", "digest", "label", "dim", "cells"])

    return run


def windows(a: np.ndarray, b: np.ndarray, half: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` (one projection), ``b`` in the window around ``a``, in chunks of bounded size."""
    order = np.argsort(b, kind="stable")
    line = b[order]
    low, high = np.searchsorted(line, a - half, "left"), np.searchsorted(line, a + half, "right")
    n = np.maximum(high - low, 0)
    ends = np.cumsum(n)
    start = 0
    while start < len(a):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        m = n[start:stop]
        inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(np.arange(start, stop), m), order[np.repeat(low[start:stop], m) + inside]
        start = stop


def colliding(shadows: np.ndarray, i: np.ndarray, j: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows of ``shadows`` (projections), those with ``least`` collisions or more.

    Pairs that can't get there any more aren't counted on.
    """
    count = np.zeros(len(i), np.int16)
    total = shadows.shape[1]
    for k in range(total):
        count += np.abs(shadows[i, k] - shadows[j, k]) <= half
        if k % 4 == 3 or k == total - 1:
            left = count + (total - 1 - k) >= least
            i, j, count = i[left], j[left], count[left]
    return i, j


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        for side in (0, 1):
            np.minimum.at(root, before[pairs[:, side]], low)
            np.minimum.at(root, pairs[:, side], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _linked(threshold: float, projections: int, width: float, depth: int, tables: int):
    spread, least = sqrt(max(2 - 2 * threshold, 0)), enough(projections)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links inside one unit of work: how many each vector has, and the smallest vector it reaches.

        A unit of work is a pair of blocks of one cell, or many small cells, which are laid side by side on
        the sorted projection, too far apart for any window. A pair that shares a cell of an earlier table too is counted there, so every pair counts once.
        """
        units = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), -1)
        first = group["first"].to_numpy()
        split = group["low"].iloc[0] != group["high"].iloc[0]
        at_a = np.flatnonzero(first)
        at_b = np.flatnonzero(~first) if split else at_a
        pairs = [np.empty((0, 2), np.int64)]
        if len(at_a) and len(at_b):
            shadows = units @ directions(units.shape[1], projections)
            table = group["table"].to_numpy()
            earlier = cell_keys(units, width, depth, tables)[:, : table.max()]
            cell = group.groupby(["label", "table", "key"], sort=False).ngroup().to_numpy()
            line = shadows[:, 0] + cell * (4 * np.abs(shadows[:, 0]).max() + 2 * LEAD)
            for i, j in windows(line[at_a], line[at_b], LEAD * spread + 1e-9):
                i, j = at_a[i], at_b[j]
                if not split:
                    i, j = i[i < j], j[i < j]
                for k, keys in enumerate(earlier.T):
                    apart = (keys[i] != keys[j]) | (table[i] <= k)
                    i, j = i[apart], j[apart]
                i, j = colliding(shadows[:, 1:], i, j, WINDOW * spread + 1e-9, least)
                same = np.empty(len(i))
                for k in range(0, len(i), 100_000):
                    same[k : k + 100_000] = np.einsum("ij,ij->i", units[i[k : k + 100_000]], units[j[k : k + 100_000]])
                linked = same >= threshold
                pairs.append(np.column_stack([i[linked], j[linked]]))
        pair = np.concatenate(pairs)
        weight = group["copies"].to_numpy()
        links = np.bincount(pair[:, 0], weight[pair[:, 1]], len(group)) + np.bincount(pair[:, 1], weight[pair[:, 0]], len(group))
        ids = group["node"].to_numpy()
        order = np.argsort(ids, kind="stable")  # roots are positions, so that positions follow the ids
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = ids[order][_roots(len(ids), place[pair])][place]
        some = links > 0
        return pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def cells(nodes: DataFrame, width: float, depth: int, tables: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``node, digest, label, dim, table, key`` for each node and table, written, and the cells that have work to do.

    Cells come with their ``size`` and number of ``blocks``. Those of one node have no work, and of cells
    with the same nodes in several tables only the first has.
    """
    keyed = nodes.select("dim", "unit", "node", "digest", "label").mapInArrow(
        _keyed(width, depth, tables), "node long, digest long, label string, dim int, cells array<long>"
    )
    rows = keep(keyed.select("node", "digest", "label", "dim", F.posexplode("cells").alias("table", "key")), "vector-cells")
    members = rows.groupBy("label", "dim", "table", "key").agg(
        F.count("*").alias("size"), *[F.bit_xor(F.xxhash64("node", "digest", F.lit(k))).alias(f"set{k}") for k in (0, 1)]
    )
    ones = members.where("size > 1").groupBy("label", "dim", "size", "set0", "set1")
    ones = ones.agg(F.min(F.struct("table", "key")).alias("cell")).select("label", "dim", "size", "cell.*")
    return rows, keep(ones.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "vector-busy")


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    projections: int = 32,
    block: int = 2048,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row of ``vectors``.

    Rows are linked when their labels are equal and not NULL and their cosine, in double precision, is
    ``threshold`` or more. Equal directions become one node with a number of copies. Nodes of a label are
    sorted into cells of several leading projections at once, in as many tables as ``layout`` says; a pair at
    the threshold shares none but for one in 100,000. Large cells are dealt into blocks of about ``block`` nodes,
    and each pair of blocks is one group, in which collisions are counted and candidates verified; small cells
    are gathered to groups of about as many nodes. Groups are of bounded size, and give a count and a root per
    node, never pairs.

    Vectors that are NULL, empty, zero or hold NULL or non-finite numbers link with nothing, nor do those
    of another length, without label or without identifier. Rows that repeat an identifier are counted as
    other vectors. An empty table gives no rows; other columns are not looked at.
    """
    rows = plain(vectors, vec_id=id_col, label=label_col, embedding=vector_col)
    units = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    units = keep(units.mapInArrow(_units(), "vec_id long, label string, dim int, unit binary"), "vector-units")
    same = ["label", "dim", "unit"]
    nodes = units.groupBy(*same).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = keep(nodes.withColumn("digest", F.xxhash64(*same)), "vector-nodes")  # an id may stand for several vectors
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0]
    how = layout(most or 0, threshold)
    keyed, busy = cells(nodes, *how, block)
    small = busy.where("blocks = 1").agg(F.sum("size")).first()[0] or 0
    lane = ["label", "dim", "table", "key"]
    own = F.pmod(F.xxhash64("node", "digest"), F.col("blocks")).cast("int").alias("own")
    placed = keyed.join(busy.drop("size"), lane).select(*lane, "node", "digest", "blocks", own)
    work = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, "own").alias("low"), F.greatest(k, "own").alias("high"), (k >= F.col("own")).alias("first")),
    )
    tasks = placed.select(*lane, "node", "digest", "blocks", F.explode(work).alias("w")).select(*lane, "node", "digest", "blocks", "w.*")
    tasks = tasks.join(nodes.select("node", "digest", "copies", "unit"), ["node", "digest"]).drop("digest")
    gathered = F.struct(F.lit("").alias("label"), F.lit(-1).alias("table"), F.pmod(F.xxhash64(*lane), F.lit(small // block + 1)).alias("key"))
    tasks = tasks.withColumn("of", F.when(F.col("blocks") == 1, gathered).otherwise(F.struct("label", "table", "key"))).drop("blocks")
    found = keep(
        tasks.groupBy("dim", "of", "low", "high").applyInPandas(
            _linked(threshold, projections, *how), "node long, links long, root long"
        ),
        "vector-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    members = units.join(nodes.select(*same, "node", "copies"), same).select("vec_id", "node", "copies").distinct()
    counted = (
        members.join(links, "node", "left")
        .join(roots, "node", "left")
        .groupBy("vec_id")
        .agg(
            F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.min(F.coalesce("component", "node")).alias("component_id"),
        )
    )
    return rows.select("vec_id").join(counted, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def op5_collision_count(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {"op5_collision_count": op5_collision_count}

SQL = {
    "op5_collision_count": """
      WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL),
      n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
      links AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id
        WHERE x.norm > 0 AND y.norm > 0 AND list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
      reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings
        UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
      components AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
      counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
      SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept
      FROM components LEFT JOIN counts USING (vec_id)""",
}
