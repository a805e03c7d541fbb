"""Online packing of documents into windows by the sum-of-squares rule."""

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import per_worker, plain
from postbag.llm.pretokens import Encoder, rank_file

Piece = tuple[int, int, int]  # row, first id, number of ids


class Packer:
    """Places pieces shorter than a window; what is full comes out at once.

    ``levels[h]`` counts the open windows that hold ``h`` ids. A piece of ``s`` ids goes to the level
    ``h`` (0: a new window) for which the sum of the squared counts is least afterwards; of equals, to
    the fullest.
    """

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        """The pieces of the window that became full, if one did."""
        s, counts = piece[2], self.levels
        reach = self.size - s
        change = 2 * counts[s : self.size + 1] + 1  # what one window more at h + s adds, h from 0
        change[reach] = 0  # a full window is not open
        change[1:] -= 2 * counts[1 : reach + 1] - 1  # what one window fewer at h takes
        change[1:][counts[1 : reach + 1] == 0] = np.iinfo(np.int64).max
        h = reach - int(np.argmin(change[::-1]))
        held = self._take(h) if h else []
        held.append(piece)
        if h + s == self.size:
            return held
        self._put(h + s, held)
        return None

    def _take(self, level: int) -> list[Piece]:
        self.levels[level] -= 1
        return self.open[level].pop()

    def _put(self, level: int, held: list[Piece]) -> None:
        self.levels[level] += 1
        self.open.setdefault(level, []).append(held)

    def close(self) -> Iterator[list[Piece]]:
        """Fills the windows that are open at the end from each other, cutting pieces; one may stay part full."""
        held: list[Piece] = []
        room = self.size
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                for row, first, length in window:
                    while length:
                        n = min(length, room)
                        held.append((row, first, n))
                        row, first, length, room = row, first + n, length - n, room - n
                        if not room:
                            yield held
                            held, room = [], self.size
        if held:
            yield held
        self.levels[:] = 0
        self.open = {}


def _packed(encode_with, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encode_with()
        packer = Packer(size)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32).tobytes()
        waiting: dict[int, list] = {}  # rows with pieces in open windows: identifier, ids from a first one on, number of ids
        row = 0
        out: list[tuple] = []

        def emit(window: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for r, first, length in window:
                doc, ids, base, total = waiting[r]
                held = ids[4 * (first - base) : 4 * (first - base + length)]
                out.append((doc, first, length, total, sequence, at, held))
                at += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 7
            out.clear()
            kinds = [kind, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                waiting[row] = (doc, ids, 0, total)
                whole = total - total % size
                for first in range(0, whole, size):
                    emit([(row, first, size)])
                if whole == total:
                    del waiting[row]
                else:
                    waiting[row] = (doc, ids[4 * whole :], whole, total)
                    full = packer.place((row, whole, total - whole))
                    if full:
                        emit(full)
                        for r, *_ in full:
                            del waiting[r]
                row += 1
                if len(out) >= 2000:
                    yield flush()
        for window in packer.close():
            emit(window)
        yield flush()

    return run


NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def rank_encoder(path: str):
    """Ids by a rank file of the same vocabulary, whole texts at once; its end string is the first free id."""
    import public_tokenizers
    import tiktoken

    ranks = rank_file(path)
    special = {"<|endoftext|>": max(ranks.values()) + 1}
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: library.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def library_encoder(path: str):
    """Ids as the library gives them, without added tokens; texts with special strings go to it whole."""
    if path.endswith(".tiktoken"):
        return rank_encoder(path)
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(path)
    specials = [x.content for x in library.get_added_tokens_decoder().values()]
    special = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")

    def ids(text: str) -> bytes:
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    by_piece = Encoder(ids)
    return lambda text: ids(text) if special.search(text) else by_piece(text)


def pack(
    docs: DataFrame,
    path: str,
    size: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    A document is its ids and then ``end_id``; ``ids`` of a piece are little-endian unsigned 32-bit
    numbers. Whole windows are cut off long documents, the rest of each is placed by :class:`Packer`.
    Each task packs what it reads and leaves at most one window that is not full: nothing is shuffled,
    and a task that runs again gives the same sequences. ``sequence_id`` is unique over tasks, not
    gapless; offsets are gapless from 0.

    NULL and empty texts are the end id alone; identifiers may be NULL or repeated. An empty table
    gives no rows; other columns are not looked at.
    """
    rows = plain(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode_with():
        return per_worker(f"library {path}", lambda: library_encoder(path))

    return rows.mapInArrow(
        _packed(encode_with, size, end_id),
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def pieces(docs: DataFrame) -> DataFrame:
    """Documents in windows of 1024 ids of the 50k byte-level vocabulary, and digests of the pieces."""
    import public_tokenizers

    # the rank file holds the vocabulary of byte_bpe_50k.json and gives the same ids in a third of the time
    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op7_packing": op7_packing}

SQL: dict[str, str] = {}
