"""Byte-level BPE with a segment tree, and its inverse."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import per_worker, plain
from postbag.llm.pretokens import pieces, rank_file

NEVER = 1 << 62
WIDE = 64  # bytes of a pre-token that is merged together with others


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token.

    The leaves of a segment tree are the byte positions. A position that starts a live part holds the
    rank of that part joined with the next one, and itself, as one number, so the root is the leftmost
    pair of the lowest rank. A merge changes at most three leaves, each up one path to the root.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    size = 1 << (n - 1).bit_length()
    tree = [NEVER] * (2 * size)
    end = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))  # where the part before it starts
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right

    def put(i: int) -> None:
        """The leaf of the part at ``i``, and the path above it."""
        nxt, value = end[i], NEVER
        if nxt < n:
            rank = ranks.get(word[i : end[nxt]])
            if rank is not None:
                value = rank << 32 | i
        at = size + i
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            at >>= 1
            low = value if value < other else other
            if tree[at] == low:
                return
            tree[at] = value = low

    while tree[1] != NEVER:
        i = tree[1] & 0xFFFFFFFF
        gone = end[i]
        end[i] = end[gone]
        if end[i] < n:
            before[end[i]] = i
        end[gone] = n  # the part is no more: its leaf turns empty
        put(gone)
        put(i)
        if before[i] >= 0:
            put(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Merger:
    """Merges many pre-tokens at once: each row of the arrays is the segment tree of one of them.

    Pre-tokens go by the size of their tree; those beyond :data:`WIDE` bytes are merged alone.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([k]), -1) for k in range(256)])
        joined = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    joined[left << 32 | right] = rank
        keys = np.fromiter(joined, np.int64, len(joined))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.fromiter(joined.values(), np.int64, len(joined))[order]

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of two parts joined, and their position, as one number."""
        if not len(self.keys):
            return np.full(left.shape, NEVER)
        pair = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[place] == pair, self.values[place] << 8 | at, NEVER)

    def __call__(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Little-endian 32-bit ids of each word."""
        out, classes = {}, {}
        for word in words:
            whole = self.ranks.get(word)
            if whole is not None:
                out[word] = np.uint32(whole).tobytes()
            elif len(word) > WIDE:
                out[word] = np.array(merge(word, self.ranks), np.uint32).tobytes()
            else:
                classes.setdefault(1 << (len(word) - 1).bit_length(), []).append(word)
        for size, members in classes.items():
            for start in range(0, len(members), 4096):
                self._merge(members[start : start + 4096], size, out)
        return out

    def _merge(self, words: list[bytes], size: int, out: dict[bytes, bytes]) -> None:
        n = np.fromiter(map(len, words), np.int64, len(words))
        parts = np.full((len(words), size), -1)  # the id of the part that starts here
        parts[np.arange(size) < n[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, size + 1), (len(words), 1))  # where the next part starts
        before = after - 2
        tree = np.full((len(words), 2 * size), NEVER)
        leaves = self.leaf(parts[:, :-1], parts[:, 1:], np.arange(size - 1))
        tree[:, size : 2 * size - 1] = np.where(parts[:, 1:] >= 0, leaves, NEVER)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            """Leaves, and the paths above them."""
            at = at + size
            tree[row, at] = value
            for _ in range(size.bit_length() - 1):
                value = np.minimum(value, tree[row, at ^ 1])
                at = at >> 1
                tree[row, at] = value

        row = np.arange(len(words))
        while True:
            best = tree[row, 1]
            row, best = row[best < NEVER], best[best < NEVER]
            if not len(row):
                break
            at, made = best & 0xFF, best >> 8
            gone = after[row, at]
            far = after[row, gone]
            parts[row, at], parts[row, gone], after[row, at] = made, -1, far
            more = far < n[row]
            before[row[more], far[more]] = at[more]
            put(row, gone, np.full(len(row), NEVER))
            right = parts[row, np.minimum(far, size - 1)]
            put(row, at, np.where(more, self.leaf(made, right, at), NEVER))
            back = before[row, at]
            some = back >= 0
            put(row[some], back[some], self.leaf(parts[row[some], back[some]], made[some], back[some]))
        live = parts >= 0
        ids = parts[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        for word, start, end in zip(words, [0, *ends[:-1].tolist()], ends.tolist()):
            out[word] = ids[start:end]


class TextEncoder:
    """Encodes whole texts by the ranks in ``path``, each match of ``pattern`` separately.

    Pieces met before are remembered, up to ``limit``; forgetting them costs time only.
    """

    def __init__(self, path: str, pattern: str, limit: int = 300_000):
        self.merger, self.words, self.limit = Merger(rank_file(path)), regex.compile(pattern).findall, limit
        self.memo: dict[str, bytes] = {}

    def many(self, texts: list[str | None]) -> list[bytes]:
        split = [pieces(x or "") for x in texts]
        if len(self.memo) > self.limit:
            self.memo.clear()
        new = list(set().union(*split).difference(self.memo)) if split else []
        found = [[w.encode("utf-8", "replace") for w in self.words(x)] for x in new]
        ids = self.merger(list(set().union(*found))) if found else {}
        memo = self.memo
        memo.update((x, b"".join([ids[w] for w in words])) for x, words in zip(new, found))
        out = [b"".join(map(memo.__getitem__, x)) for x in split]
        for x in new:
            if len(x) > WIDE:
                del memo[x]
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def _lists(parts: list[bytes]) -> pa.Array:
    """Arrays of ids from their little-endian bytes."""
    offsets = np.cumsum([0, *[len(p) // 4 for p in parts]], dtype=np.int32)
    values = np.frombuffer(b"".join(parts), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(f"bpe {path}", lambda: encoder(path, pattern))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = _lists(encode.many(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``, an array of the whole text's ids, for each row; without shuffle.

    ``path`` is a rank file that every executor has. NULL and empty texts have no ids; identifiers may
    be NULL or repeated. An empty table gives no rows; other columns are not looked at.
    """
    rows = plain(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(path, pattern), f"doc_id {kind}, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokens() -> list[bytes]:
            ranks = rank_file(path)
            out = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                out[rank] = token
            return out

        token = per_worker(f"tokens {path}", tokens).__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = part.column(part.schema.get_field_index("ids"))
                values = lists.values.to_numpy(zero_copy_only=False)
                edges = lists.offsets.to_numpy()
                texts = [
                    b"".join(map(token, values[a:b].tolist())) if known else None
                    for a, b, known in zip(edges[:-1], edges[1:], lists.is_valid().to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of column ``ids``; NULL where that is NULL, empty where it is empty.

    Ids that the rank file lacks raise an error. A column ``decoded`` of the input is replaced.
    """
    rows = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decoded(path), f"{schema}, decoded binary")


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(spark.read.parquet(f"{folder}/documents.parquet"), path, public_tokenizers.PATTERN)
    return decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op8_bpe": op8_bpe}

SQL: dict[str, str] = {}
