"""Token counts with a shortcut for words that are proven to be one token."""

import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.llm.common import Bounded, per_worker, plain

# Letters and signs for which case, composition and classes are the same in every Unicode version:
# printable ASCII, line ends, Latin with diacritics (but dotted capital I), curly quotes and dashes.
SAFE = regex.compile(r"[\x20-\x7E\t\n\r¡-įı-ſ–—‘-”…]*")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordCounter:
    """Counts the tokens of texts as the library does for a word-end vocabulary.

    When it is built, each vocabulary string that ends a word is encoded alone by the library; those
    that come back as that one token, and that the pattern leaves whole, are the proven ones. A
    pre-token among them counts one without any merge. All others are merged by the library, once each.
    Texts with characters beyond :data:`SAFE`, or with what may be a special token, go to the library
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        specials = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)")
        words = {w: i for t, i in vocabulary.items() if t.endswith("</w>") and (w := self._text(t[:-4]))}
        names = list(words)
        encoded = self.library.encode_batch(names, add_special_tokens=False)
        self.proven = frozenset(
            w for w, e in zip(names, encoded) if e.ids == [words[w]] and WORDS.fullmatch(w) and w == w.lower()
        )
        self.memo = Bounded(self._count_chunk)

    @staticmethod
    def _text(token: str) -> str | None:
        """The text of a token in the byte alphabet, if it is one of ASCII characters."""
        return token if token.isascii() and token.isprintable() else None

    def _merged(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _count_chunk(self, chunk: str) -> int:
        return sum(1 if w in self.proven else self._merged(w) for w in WORDS.findall(chunk))

    def __call__(self, text: str) -> int:
        if not SAFE.fullmatch(text) or self.special.search(text):
            return self._merged(text)
        return sum(map(self.memo.__getitem__, text.lower().split()))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = per_worker(f"word-counter {path}", lambda: WordCounter(path))
        for batch in batches:
            counts = [count(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text, without shuffle.

    ``path`` is a vocabulary file that every executor has. NULL and empty texts have no bytes and no
    tokens; identifiers may be NULL or repeated, each row is counted by itself. An empty table gives
    no rows; other columns are not looked at.
    """
    rows = plain(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_counted(path), f"doc_id {kind}, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(
        spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {"op6_token_counts": op6_token_counts}

SQL: dict[str, str] = {}
