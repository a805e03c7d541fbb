"""WARC archives through a chunked record table: records as rows of identifier, chunk number and bytes.

Writing and reading use Spark's text files, so archives lie wherever Spark can write. A payload longer
than a chunk is segmented as the format provides for: a first record and continuation records that name
it, one row each. A reader takes a file as a stream of bytes and carries the digests along, so neither
side puts a record together in memory.
"""

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag import workspace
from postbag.llm.common import keep, plain

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
RECORD = "urn:record:"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a digest of 160 bits in hexadecimal."""
    parts = [
        F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to`` of each row.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest identifier is
    the response and the others revisit it. Payloads are equal when length, SHA-1 and SHA-256 are.
    """
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumns(
        {
            "digest": base32(F.sha1(F.col("payload").cast("binary"))),
            "same": F.unhex(F.sha2(F.col("payload").cast("binary"), 256)),
            "n": F.octet_length("payload").cast("long"),
        }
    )
    first = rows.groupBy("same", "digest", "n").agg(F.min("page_id").alias("first"))
    known = keep(first.where(F.col("n") >= least_bytes), "warc-first")
    return rows.join(known, ["same", "digest", "n"], "left").withColumn(
        "refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))
    )


def _lines(*fields: tuple[str, Column | str | None]) -> Column:
    """Header lines; a field whose value is NULL is left out."""
    made = [F.concat(F.lit(name + ": "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for name, v in fields]
    return F.concat(F.lit(VERSION + CRLF), *[F.coalesce(m, F.lit("")) for m in made], F.lit(CRLF))


def chunk_table(marked: DataFrame, chunk_chars: int = 1 << 20) -> DataFrame:
    """``record_id``, ``chunk_no`` and ``data``: the text of one WARC record each, in order.

    A payload of more than ``chunk_chars`` characters has several; revisits have no payload.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f<>]", "%20")
    chunks = F.when(F.col("refers_to").isNotNull(), 1).otherwise(
        F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk_chars))
    )
    rows = marked.select(
        "*", url.alias("uri"), chunks.cast("int").alias("chunks"), F.explode(F.sequence(F.lit(1), chunks.cast("int"))).alias("chunk_no")
    )
    piece = F.when(F.col("refers_to").isNotNull(), "").otherwise(
        F.substring("payload", (F.col("chunk_no") - 1) * chunk_chars + 1, F.lit(chunk_chars))
    )
    block = F.when(F.col("chunk_no") == 1, F.concat(F.lit(HTTP), piece)).otherwise(piece)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    segmented, later = F.col("chunks") > 1, F.col("chunk_no") > 1
    kind = F.when(later, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    rows = rows.withColumns({"block": block, "name": name, "kind": kind})
    own = F.concat(F.lit(f"<{RECORD}"), "name", F.when(later, F.concat(F.lit("#"), "chunk_no")).otherwise(""), F.lit(">"))
    header = _lines(
        ("WARC-Type", F.col("kind")),
        ("WARC-Record-ID", own),
        ("WARC-Target-URI", F.when(F.col("uri") != "", F.col("uri"))),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", F.when(~later, F.concat(F.lit("sha1:"), "digest"))),
        ("WARC-Profile", F.when(F.col("kind") == "revisit", PROFILE)),
        ("WARC-Refers-To", F.when(F.col("kind") == "revisit", F.concat(F.lit(f"<{RECORD}"), F.col("refers_to").cast("string"), F.lit(">")))),
        ("WARC-Segment-Number", F.when(segmented, F.col("chunk_no").cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(later, F.concat(F.lit(f"<{RECORD}"), "name", F.lit(">")))),
        ("WARC-Segment-Total-Length", F.when(later & (F.col("chunk_no") == F.col("chunks")), (F.col("n") + len(HTTP)).cast("string"))),
        ("Content-Type", F.when(~later, "application/http;msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    return rows.select(F.col("name").alias("record_id"), "chunk_no", F.concat(header, "block", F.lit(CRLF)).alias("data"))


def write_archives(chunks: DataFrame, path: str) -> None:
    """Gzip-compressed archives, one per task; the chunks of a record are neighbours in one file."""
    chunks.select("data").write.mode("overwrite").option("lineSep", CRLF).option("compression", "gzip").text(path)


class Reader:
    """Takes an archive in pieces of any size, and gives the fields of each record as it ends.

    Of payloads only the digest and the length are kept. Both go on over the continuations of a record,
    so the last of them has those of the whole payload.
    """

    def __init__(self):
        self.wait, self.left, self.fields = b"", 0, None
        self.digest, self.total, self.chunks = hashlib.sha1(), 0, 0

    def feed(self, data: bytes) -> Iterator[dict]:
        self.wait += data
        while self.wait:
            if self.fields is None:
                self.wait = self.wait.lstrip(b"\r\n")
                at = self.wait.find(END)
                if at < 0:
                    return
                lines = self.wait[:at].decode("utf-8", "replace").split(CRLF)
                pairs = (line.partition(":") for line in lines[1:])
                self.fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
                self.left = int(self.fields.get("content-length", 0))
                self.wait = self.wait[at + len(END) :]
                if self.fields.get("warc-type") != "continuation":
                    self.digest, self.total, self.chunks = hashlib.sha1(), 0, 0
                self.chunks += 1
                self.head = b"" if "http" in self.fields.get("content-type", "") else None
            if self.left:
                block, self.wait = self.wait[: self.left], self.wait[self.left :]
                self.left -= len(block)
                if self.head is not None:
                    self.head += block
                    at = self.head.find(END)
                    block = b"" if at < 0 else self.head[at + len(END) :]
                    self.head = None if at >= 0 else self.head
                self.digest.update(block)
                self.total += len(block)
            if not self.left:
                done, self.fields = self.fields, None
                yield done | {"digest": self.digest.digest(), "size": self.total, "chunks": self.chunks}
            elif not self.wait:
                return


def _name(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>").removeprefix(RECORD).split("#")[0]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, path, last, rows = Reader(), None, None, []

    def take(record: dict) -> None:
        """A record is complete when the next one is not a continuation of it."""
        nonlocal last
        if record.get("warc-type") != "continuation":
            close()
            last = {
                "record": _name(record.get("warc-record-id")),
                "kind": record.get("warc-type"),
                "refers": _name(record.get("warc-refers-to")),
                "named": record.get("warc-payload-digest", "").removeprefix("sha1:"),
            }
        last |= {k: record[k] for k in ("size", "chunks", "digest")}

    def close() -> None:
        nonlocal last
        if last:
            rows.append(last | {"digest": base64.b32encode(last["digest"]).decode()})
        last = None

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist(rows, FOUND)
        rows.clear()
        return out

    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if file != path:
                close()
                reader, path = Reader(), file
            for record in reader.feed(data + CRLF.encode()):
                take(record)
        yield flush()
    close()
    yield flush()


FOUND = pa.schema(
    [("record", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("named", pa.string())]
    + [("size", pa.int64()), ("chunks", pa.int64()), ("digest", pa.string())]
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``record``, ``kind``, ``refers``, ``named`` digest, and what was read:
    ``size``, ``chunks``, ``digest`` of the payload.

    A compressed file is read by one task from its start to its end, so archives are as large as the
    task that wrote them. Blank characters between records are passed over.
    """
    lines = spark.read.option("lineSep", CRLF).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(
        _read, "record string, kind string, refers string, named string, size long, chunks long, digest string"
    )


def warc_round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    chunk_chars: int = 1 << 20,
    path: str | None = None,
) -> DataFrame:
    """Writes a record per row to ``path`` and reads the archives back.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``chunks``. Length
    and digest are those of the bytes that were read; of a revisit, those of the response it refers to,
    and NULL where that has another digest than the revisit names.

    A NULL payload is empty. Rows without identifier are responses of their own; rows that repeat the
    identifier and payload of a response are responses too. An empty table gives no rows; other columns
    are not looked at.
    """
    spark = pages.sparkSession
    rows = plain(pages, page_id=id_col, url=url_col, html=html_col)
    kind = rows.schema["page_id"].dataType
    path = path or workspace.fresh(spark, "warc")
    write_archives(chunk_table(mark_revisits(rows, least_bytes), chunk_chars), path)
    records = keep(read_archives(spark, path), "warc-records")
    responses = records.where("kind = 'response'").select(
        F.col("record").alias("refers"), F.col("digest").alias("named"), F.col("size").alias("found")
    ).distinct()
    plainly = records.where("kind = 'response'").select(
        "record", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "kind", "refers", "chunks"
    )
    again = records.where("kind = 'revisit'").join(responses, ["refers", "named"], "left").select(
        "record", F.col("found").alias("payload_bytes"), F.when(F.col("found").isNotNull(), F.col("named")).alias("payload_digest"), "kind", "refers", "chunks"
    )
    return plainly.unionByName(again).select(
        F.when(F.col("record") != "", F.col("record")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
        "chunks",
    )


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc_round_trip(spark.read.parquet(f"{folder}/pages.parquet"))


QUERIES = {"op1_warc": op1_warc}

SQL: dict[str, str] = {}
