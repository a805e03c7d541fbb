"""Vector codes: parts of vectors replaced by the nearest entries of learnt codebooks, without error.

Rounds of assigning and averaging keep, for each part of a vector and each group of entries, a lower
bound of the distance to all entries of the group but the own one, and the round it was measured in.
All earlier codebooks are kept as well. So a bound is lowered by how far the entries really are from
where they stood in that round, the norm of the sum of their moves, and not by the sum of the norms of
all moves since. Only where a lowered bound reaches the distance to the own entry is a group
searched again, exactly.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import keep, plain
from postbag.operators.skew import salted_join
from postbag.workspace import Stages

SCALE = 1024
LARGEST = 1 << 28  # components are held to this size, so that squared distances are whole 64-bit numbers
EXACT = float(1 << 53)
BLOCK = 4096  # rows whose distances are computed at once


def _integers(batch: pa.Array, width: int) -> np.ndarray:
    """``floor(1024 x)`` of the vectors as rows of ``width``, cut or filled with zeros."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    size = len(flat) // len(batch) if len(batch) else width
    out = np.zeros((len(batch), width), np.int64)
    out[:, :size] = whole.reshape(len(batch), size)
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(initial=0)
    return x.astype(np.int16 if top < 1 << 15 else np.int32)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries as whole numbers, in doubles where these are exact."""
    reach = 4.0 * max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) ** 2 * x.shape[1]
    if reach < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k : k + 1] - entries[:, k]) ** 2
    return out


def own_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row to the entry beside it."""
    return ((x - entries) ** 2).sum(1)


def spans(size: int, groups: int) -> list[tuple[int, int]]:
    """The entries of a codebook in groups of neighbours, none empty."""
    cuts = np.linspace(0, size, min(groups, size) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def displacements(history: list[np.ndarray], groups: list[tuple[int, int]]) -> np.ndarray:
    """``[round, group]``: the longest way from an entry's place in that round to its place now."""
    now = history[-1].astype(np.float64)
    out = np.zeros((len(history), len(groups)))
    for r, then in enumerate(history):
        net = np.sqrt(((now - then) ** 2).sum(1))
        out[r] = [net[a:b].max() for a, b in groups]
    return out


def _below(root: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are surely not above these."""
    return np.maximum(np.nextafter((root * (1 - 1e-6)).astype(np.float32), np.float32(-1)), np.float32(0))


def assign(
    x: np.ndarray,
    history: list[np.ndarray],
    groups: list[tuple[int, int]],
    code: np.ndarray | None,
    bound: np.ndarray | None,
    stamp: np.ndarray | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of the newest codebook for each row, ties to the lower index.

    Without a code all groups are searched. Gives codes, squared distances, bounds, stamps and the
    number of distances that were computed.
    """
    entries, n, now = history[-1], len(x), len(history) - 1
    if code is None:
        code, best = np.zeros(n, np.int64), np.full(n, np.inf)
        bound, stamp = np.zeros((n, len(groups)), np.float32), np.zeros((n, len(groups)), np.uint8)
        search, computed = np.ones((n, len(groups)), bool), 0
        first = True
    else:
        code = code.astype(np.int64)
        best = own_distances(x, entries[code])
        net = displacements(history, groups)
        lowered = bound - net[stamp, np.arange(len(groups))] * (1 + 1e-6) - 1e-6
        search = lowered <= np.sqrt(best.astype(np.float64))[:, None] * (1 + 1e-9)
        computed, first = n, False
    before, own = code.copy(), best.copy()
    best = best.copy()
    least, second, nearest = {}, {}, {}
    for g, (a, b) in enumerate(groups):
        rows = np.flatnonzero(search[:, g])
        d = distances(x[rows], entries[a:b])
        computed += d.size
        nearest[g] = a + d.argmin(1) if len(rows) else rows
        least[g] = d.min(1) if len(rows) else d.sum(1)
        rest = d.astype(np.float64)
        rest[np.arange(len(rows)), nearest[g] - a] = np.inf
        second[g] = rest.min(1) if len(rows) else least[g]
        better = (least[g] < best[rows]) | ((least[g] == best[rows]) & (nearest[g] < code[rows]))
        code[rows[better]] = nearest[g][better]
        best[rows[better]] = least[g][better]
    bound, stamp = bound.copy(), stamp.copy()
    for g, (a, b) in enumerate(groups):
        rows = np.flatnonzero(search[:, g])
        d = np.where(nearest[g] == code[rows], second[g], least[g]).astype(np.float64)
        bound[rows, g] = _below(np.sqrt(np.minimum(d, 1e70)))
        stamp[rows, g] = now
        if not first:  # the former entry counts in its group from now on, if that was not searched
            left = (before != code) & (before >= a) & (before < b) & ~search[:, g]
            reach = np.minimum(lowered[left, g], np.sqrt(own[left].astype(np.float64)))
            bound[left, g] = _below(np.maximum(reach, 0))
            stamp[left, g] = now
    return code, best.astype(np.int64), bound, stamp, computed


class Codebooks:
    """Codebooks of all rounds, ``[round][part]``, each an array of entries."""

    def __init__(self, first: np.ndarray, parts: int, groups: int):
        self.parts, self.width = parts, first.shape[1] // parts
        self.rounds = [[first[:, p * self.width : (p + 1) * self.width] for p in range(parts)]]
        self.groups = spans(len(first), groups)

    @property
    def size(self) -> int:
        return len(self.rounds[0][0])

    def move(self, counts: np.ndarray, sums: np.ndarray) -> None:
        """Entries go to the floored means of their parts; unused ones stay."""
        now = self.rounds[-1]
        self.rounds.append(
            [
                np.where(counts[p][:, None] > 0, sums[p] // np.maximum(counts[p], 1)[:, None], now[p])
                for p in range(self.parts)
            ]
        )

    def history(self, part: int) -> list[np.ndarray]:
        return [books[part] for books in self.rounds]

    @property
    def kind(self) -> np.dtype:
        """Codes as bytes, most significant first, so that their hex digits are those of the numbers."""
        return np.dtype(np.uint8 if self.size <= 256 else ">u2")

    def digest(self) -> str:
        cells = np.concatenate([book.ravel() for book in self.rounds[-1]])
        return hashlib.sha256(",".join(map(str, cells.tolist())).encode()).hexdigest()


STATE = "vec_id {id}, label {label}, vector binary, codes binary, bounds binary, stamps binary, error long, computed long"


def _assigned(books: Codebooks):
    parts, width, groups, kind = books.parts, books.width, books.groups, books.kind
    fresh = len(books.rounds) == 1
    history = [books.history(p) for p in range(parts)]

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        vectors = [np.frombuffer(v.as_py(), np.int16 if len(v.as_py()) == 2 * parts * width else np.int32) for v in batch["vector"]]
        x = np.array(vectors, np.int64)
        old = None
        if not fresh:
            old = [
                np.frombuffer(b"".join(batch[name].to_pylist()), of).reshape(n, parts, -1)
                for name, of in (("codes", kind), ("bounds", np.float32), ("stamps", np.uint8))
            ]
        error, computed, new = np.zeros(n, np.int64), 0, []
        for p in range(parts):
            state = (None, None, None) if old is None else (old[0][:, p, 0], old[1][:, p], old[2][:, p])
            code, d, bound, stamp, work = assign(x[:, p * width : (p + 1) * width], history[p], groups, *state)
            error += d
            computed += work
            new.append((code[:, None], bound, stamp))
        cells = [np.stack([part[i] for part in new], 1).astype(of) for i, of in enumerate((kind, np.float32, np.uint8))]
        columns = [pa.array([row.tobytes() for row in c], pa.binary()) for c in cells]
        spent = np.zeros(n, np.int64)
        spent[0] = computed
        return pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["label"], batch["vector"], *columns, pa.array(error), pa.array(spent)],
            ["vec_id", "label", "vector", "codes", "bounds", "stamps", "error", "computed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(start, BLOCK))

    return run


def _summed(parts: int, width: int, size: int, kind: np.dtype):
    """Count and sums of the vectors of a task, by part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            for vector, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(vector, np.int16 if len(vector) == 2 * parts * width else np.int32)
                at = (np.arange(parts), np.frombuffer(codes, kind))
                counts[at] += 1
                sums[at] += x.reshape(parts, width)
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "n", *[f"s{k}" for k in range(width)]]
        )

    return run


def _means(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums per entry over all rows: parts times entries rows, however many vectors there are."""
    names = ["n", *[f"s{k}" for k in range(books.width)]]
    schema = "part long, entry long, " + ", ".join(f"{c} long" for c in names)
    rows = state.select("vector", "codes").mapInArrow(_summed(books.parts, books.width, books.size, books.kind), schema)
    rows = rows.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names])
    counts = np.zeros((books.parts, books.size), np.int64)
    sums = np.zeros((books.parts, books.size, books.width), np.int64)
    for row in rows.collect():
        counts[row.part, row.entry] = row.n
        sums[row.part, row.entry] = row[3:]
    return counts, sums


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column(2), width)
            vectors = pa.array([_narrow(row).tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors], ["vec_id", "label", "vector"])

    return run


def encode(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    size: int = 256,
    rounds: int = 4,
    groups: int = 8,
) -> tuple[DataFrame, Codebooks]:
    """The written rows of all vectors with their ``codes`` and ``error``, and the codebooks of all rounds.

    Components become whole numbers ``floor(1024 x)``. A codebook starts as the parts of the ``size``
    smallest identifiers. Distances and means are exact; bounds only save work. What comes to the driver
    are the codebooks, ``parts * size`` entries a round.

    Left out: NULL vectors, those with NULL or non-finite components, empty ones, and those whose length
    is not that of the first kept vector. A length that ``parts`` doesn't divide is filled up with zeros.
    Components beyond 2**28 after scaling count as that. Rows without identifier are encoded, but come
    last for the codebooks; repeated rows are rows of their own.
    """
    spark = vectors.sparkSession
    rows = plain(vectors, vec_id=id_col, label=label_col, vector=vector_col)
    finite = "size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = rows.where("vector IS NOT NULL").where(finite)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    length = len(start[0].vector) if start else parts
    rows = rows.where(F.size("vector") == length)
    width = -(-length // parts)
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    packed = rows.mapInArrow(_packed(parts * width), f"vec_id {id_kind}, label {label_kind}, vector binary")
    smallest = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(size).select("vector").collect()
    first = _integers(pa.array([r.vector for r in smallest], pa.list_(pa.float64())), parts * width)
    books = Codebooks(first, parts, groups)
    schema, stages, state = STATE.format(id=id_kind, label=label_kind), Stages(spark), packed
    for r in range(rounds + 1):
        assigned = state.mapInArrow(_assigned(books), schema)
        if r == rounds:
            out = keep(assigned.select("vec_id", "label", "codes", "error"), "vector-codes")
        else:
            following = stages.keep(assigned, "vector-bounds")
            books.move(*_means(following, books))
            if r:
                stages.drop(state)
            state = following
    stages.drop()
    return out, books


def with_label_error(encoded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all vectors with an equal label, NULL being one, summed.

    Sums are formed before the shuffle; rows of a label that has very many are spread over tasks.
    """
    keys = {"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    rows = encoded.withColumns(keys)
    sums = rows.groupBy(*keys).agg(F.sum("error").alias("label_error"))
    return salted_join(rows, sums, list(keys), ("vec_id", "codes", "error"), "left").drop(*keys)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    encoded, books = encode(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return with_label_error(encoded).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )


QUERIES = {"op12_vector_codes": op12_vector_codes}



def _sql_round(r: int) -> str:
    """Parts to their nearest entries of codebook ``r``, and the means that make codebook ``r + 1``."""
    return f"""
      a{r} AS MATERIALIZED (
        SELECT vec_id, label, p, x, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))),
                                         'e': e}}) AS best
        FROM parts JOIN b{r} USING (p) GROUP BY ALL),
      c{r} AS (SELECT p, e, i, sum(v) AS s, count(*) AS n
               FROM (SELECT p, best.e AS e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL),
      m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM c{r} GROUP BY ALL),
      b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m USING (p, e)),"""


SQL = {
    "op12_vector_codes": f"""
      WITH parts AS MATERIALIZED (
        SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x
        FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             (SELECT unnest(range(4)) AS p)),
      b0 AS MATERIALIZED (SELECT p, e, y FROM (
        SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts) WHERE e < 256),
      {"".join(_sql_round(r) for r in range(5))}
      books AS (SELECT string_agg(y, ',' ORDER BY p, e) AS books
                FROM (SELECT p, e, array_to_string(y, ',') AS y FROM b4)),
      coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
                FROM a4 GROUP BY ALL)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
             sha256(books) AS codebooks_sha256
      FROM coded, books"""
}
