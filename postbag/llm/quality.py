"""Quality by an additive model of text measures, with pairs of measures where they act together.

Each measure is cut into bins and has a table of what each bin adds to the log-odds. The tables are
grown in turns: every measure gets one small tree on what all the others leave unexplained, a little of
it is added to its table, and so on round after round. Then pairs of measures get tables of their own
in the same way. A score is a sum of look-ups.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import plain

PIECE = 4_000_000  # bytes of a long text whose words are held at once

#: Kinds of bytes: blank, line end, lower case, upper case, digit, end of a sentence, other common mark, sign, beyond ASCII.
BLANK, LINE, LOWER, UPPER, DIGIT, STOP, MARK, SIGN, HIGH = range(9)
KINDS = np.full(256, SIGN, np.uint8)
for _kind, _members in (
    (BLANK, b" \t\x0b\x0c\r"), (LINE, b"\n"), (LOWER, bytes(range(97, 123))), (UPPER, bytes(range(65, 91))),
    (DIGIT, b"0123456789"), (STOP, b".!?"), (MARK, b",;:'\"()-"), (HIGH, bytes(range(128, 256))),
):
    KINDS[list(_members)] = _kind

MEASURES = (
    "log_words", "word_bytes", "letters", "upper", "digits", "stops", "marks", "signs", "high", "line_bytes",
    "distinct_words", "top_word", "short_words", "repeated_lines", "squeezed", "signed_words",
)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that end between words, where there is a blank to cut at."""
    start = 0
    while len(text) - start > PIECE:
        cut = max(text.rfind(b" ", start + 1, start + PIECE), text.rfind(b"\n", start + 1, start + PIECE))
        cut = cut if cut > 0 else start + PIECE
        yield text[start:cut]
        start = cut
    yield text[start:]


def measures(text: bytes | None) -> list[float]:
    """The measures of a whole text; an empty one has zeros."""
    text = text or b""
    kinds, words, lines = np.zeros(9, np.int64), Counter(), Counter()
    short = signed = squeezed = last = 0
    packer = zlib.compressobj(1)
    for piece in _pieces(text):
        data = np.frombuffer(piece, np.uint8)
        of = KINDS[data]
        kinds += np.bincount(of, minlength=9)
        inside = of > LINE
        ends = np.flatnonzero(inside & ~np.append(inside[1:], False))
        starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        short += int((ends - starts < 3).sum())
        signed += int((of[ends] == SIGN).sum())
        words.update(piece.split())
        lines.update(map(hash, piece.split(b"\n")) if len(text) > PIECE else piece.split(b"\n"))
        squeezed += len(packer.compress(piece))
    squeezed += len(packer.flush())
    n, solid = sum(words.values()), len(text) - int(kinds[BLANK] + kinds[LINE])
    if not n:
        return [0.0] * len(MEASURES)
    cased, many = int(kinds[UPPER] + kinds[LOWER]), sum(lines.values())
    return [
        np.log1p(n), solid / n, (cased + kinds[HIGH]) / solid, kinds[UPPER] / max(cased, 1), kinds[DIGIT] / solid,
        kinds[STOP] / n, kinds[MARK] / n, kinds[SIGN] / n, kinds[HIGH] / solid, np.log1p(len(text) / many),
        len(words) / n, max(words.values()) / n, short / n, 1 - len(lines) / many, squeezed / (len(text) + 20), signed / n,
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [measures(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["good", "x"])


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a small tree over the bins in order, split where most is gained."""
    out = np.zeros(len(gradient))
    g, h = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))

    def worth(a: int, b: int | np.ndarray) -> float | np.ndarray:
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        found = []
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(gain.argmax())
                found.append((float(gain[k]), a, int(at[k]), b))
        if not found or max(found)[0] <= 0:
            break
        _, a, cut, b = max(found)
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps of the best four fields that one cut of each measure makes, and what they gain."""
    g = np.pad(gradient.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(weight.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    m, n = gradient.shape

    def fields(s: np.ndarray) -> list[np.ndarray]:
        low = s[1:m, 1:n]
        left, top = s[m, 1:n][None, :] - low, s[1:m, n][:, None] - low
        return [low, top, left, s[m, n] - low - left - top]

    if m < 2 or n < 2:
        return np.zeros_like(gradient), 0.0
    a, b = fields(g), fields(h)
    worth = sum(x * x / (y + ridge) for x, y in zip(a, b))
    i, j = np.unravel_index(int(worth.argmax()), worth.shape)
    step = [float(x[i, j] / (y[i, j] + ridge)) for x, y in zip(a, b)]
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return out, float(worth[i, j])


@dataclass
class Model:
    """Cuts between bins and what each bin adds; pairs have tables over fewer bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, by additions of looked-up columns in a fixed order."""
        z = np.full(len(x), self.base)
        if len(x):
            fine, wide = self.bins(x, self.cuts), self.bins(x, self.coarse)
            for k, table in enumerate(self.tables):
                z += table[fine[:, k]]
            for i, j, table in self.pairs:
                z += table[wide[:, i], wide[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _quantiles(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.empty(0)


def fit(
    x: np.ndarray, good: np.ndarray, bins: int = 64, wide: int = 12, rounds: int = 120, pairs: int = 8, rate: float = 0.1
) -> Model:
    """Tables by cyclic boosting, measures first and then the ``pairs`` that explain most of what is left."""
    n, kinds = x.shape
    cuts, coarse = ([_quantiles(x[:, k], b) for k in range(kinds)] for b in (bins, wide))
    share = (good.sum() + 1) / (n + 2)
    model = Model(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse)
    if not 0 < good.sum() < n:
        return model
    at, over, z = Model.bins(x, cuts), Model.bins(x, coarse), np.full(n, model.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return good - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = (np.bincount(at[:, k], v, len(table)) for v in left())
            step = rate * _tree(g, h)
            table += step
            z += step[at[:, k]]
    shapes = [len(c) + 1 for c in coarse]

    def crossed(i: int, j: int) -> tuple[np.ndarray, float]:
        cell = over[:, i] * shapes[j] + over[:, j]
        g, h = (np.bincount(cell, v, shapes[i] * shapes[j]).reshape(shapes[i], shapes[j]) for v in left())
        return _pair_tree(g, h)

    ranked = sorted(combinations(range(kinds), 2), key=lambda p: -crossed(*p)[1])
    model.pairs = [(i, j, np.zeros((shapes[i], shapes[j]))) for i, j in ranked[:pairs]]
    for _ in range(rounds):
        for i, j, table in model.pairs:
            step = rate * crossed(i, j)[0]
            table += step
            z += step[over[:, i], over[:, j]]
    return model


def fold_of(id_name: str):
    return F.crc32(F.col(id_name).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000) -> Model:
    """The model, from labelled rows whose ``crc32(doc_id as text) mod 5`` is not 0.

    It is fitted on the measures of at most ``sample`` rows, those with the smallest hashes; only these
    numbers come to the driver. A document with several labels is good if all say so; NULL ones are ignored.
    Without labels of both kinds every text has the same score.
    """
    marks = plain(labels, doc_id="doc_id", quality="quality").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    marks = marks.where(fold_of("doc_id") != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # all labels, or a share of them by hash that is a little below the bound
    share = min(1.0, 0.9 * sample / max(marks.count(), 1))
    of = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    marks = marks.where(of < F.lit(int(share * (1 << 40)))).orderBy(of, "doc_id").limit(sample)
    texts = plain(docs, doc_id=id_col, text=text_col).join(F.broadcast(marks), "doc_id")
    rows = texts.select((F.col("quality") == 1).cast("int").alias("good"), "text").mapInArrow(_measured, "good int, x array<double>")
    found = rows.orderBy(F.xxhash64("x", "good"), "x", "good").limit(sample).toArrow()
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, len(MEASURES))
    return fit(x, found["good"].to_numpy().astype(np.float64))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            x = np.array([measures(t.as_py()) for t in texts], np.float64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` for each row, from whole texts and from nothing else.

    NULL, empty and blank texts have the measures of an empty text. Identifiers may be NULL or repeated.
    An empty table gives no rows; other columns are not looked at.
    """
    rows = plain(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scored(model), f"doc_id {kind}, score double")


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        (fold_of("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


QUERIES = {"op11_quality": op11_quality}

SQL: dict[str, str] = {}
