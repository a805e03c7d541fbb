"""Writing streams to tables in the shared folder, safe to replay."""

from collections.abc import Callable, Sequence
from threading import Condition

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from postbag.operators.history import latest_by_key
from postbag.sources.contacts import load_lines
from postbag.streaming.sources import stream_lines

BATCH = "batch_id"


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over all input there is now, appending finished rows to a parquet table."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    reduce: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "update",
) -> StreamingQuery:
    """Run over all input there is now, keeping one folder of changed rows per batch.

    A batch that is run again replaces its own folder, so a replay changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = reduce(batch) if reduce else batch
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])


def _latest_upserts(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    order: Sequence[str],
    base: str | None,
) -> DataFrame:
    rows = spark.read.schema(_with_batch(schema)).parquet(path)
    if base:
        old = spark.read.schema(_with_batch(schema)).parquet(base)
        last = old.agg(F.max(BATCH)).scalar()
        rows = rows.where(F.col(BATCH) > F.coalesce(last, F.lit(-1))).unionByName(old)
    return latest_by_key(rows, keys, order)


def read_upserts(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    order: Sequence[str] = (BATCH,),
    base: str | None = None,
) -> DataFrame:
    """Current row per key of a table written by ``upsert_sink``.

    ``base`` names a table made by ``compact_upserts``; only later batches are read beside it.
    """
    return _latest_upserts(spark, path, schema, keys, order, base).drop(BATCH)


def compact_upserts(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keys: Sequence[str],
    target: str,
    order: Sequence[str] = (BATCH,),
    base: str | None = None,
) -> None:
    """Write the current row per key to ``target``, so that reading need not go over all batches.

    The newest batch must be complete: call it between runs of the stream.
    """
    newest = F.max(BATCH).alias(BATCH)
    last = spark.read.schema(_with_batch(schema)).parquet(path).agg(newest).scalar()
    current = _latest_upserts(spark, path, schema, keys, order, base)
    current.withColumn(BATCH, last).write.mode("overwrite").parquet(target)


def stream_run_status(
    changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ("seq",)
) -> StreamingQuery:
    """Status changes to a table of latest states; read it with ``read_upserts(order=('seq',))``."""
    return upsert_sink(
        changes, path, checkpoint, lambda batch: latest_by_key(batch, list(keys), list(order)), "append"
    )


def contact_sink(spark: SparkSession, folder: str, path: str, checkpoint: str, ts: Column, **options) -> StreamingQuery:
    """Contact files as they arrive, each under its own header and as a run of its own.

    Each batch has a folder for the contacts it accepts and one for the rows of the run log; a file without
    a required column gets its row, with the reason, and the stream goes on. A batch that is run again
    replaces its folders. ``read_contact_sink`` reads both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        contacts, runs = load_lines(batch, ts)
        for name, rows in (("contacts", contacts), ("runs", runs)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/{BATCH}={batch_id}")

    return (
        stream_lines(spark, folder, **options)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_contact_sink(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted contacts and run log of ``contact_sink``."""
    return tuple(spark.read.parquet(f"{path}/{name}").drop(BATCH) for name in ("contacts", "runs"))


class LateRows(StreamingQueryListener):
    """Rows read, and rows left out as too late, over all batches of the streams of a session.

    Add it with ``spark.streams.addListener`` before a stream starts. A stream that is started again from its
    checkpoint goes on under its id; a batch that is run again counts once. State operators see what was
    combined before the shuffle, so a late row of an aggregate stands for those combined with it.
    """

    def __init__(self):
        self.counts: dict[str, tuple[int, int, int, int, int]] = {}  # batch, its two figures, those of all before
        self.ended: set[str] = set()
        self.changed = Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen, late = p.numInputRows, sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        last, had_seen, had_late, all_seen, all_late = self.counts.get(str(p.id), (-1, 0, 0, 0, 0))
        if p.batchId > last:
            self.counts[str(p.id)] = (p.batchId, seen, late, all_seen + had_seen, all_late + had_late)
        elif p.batchId == last:  # without data, or once more
            self.counts[str(p.id)] = (last, max(seen, had_seen), max(late, had_late), all_seen, all_late)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of(self, query: StreamingQuery, wait: float = 60) -> tuple[int, int]:
        """Rows read and rows too late, so far; of a stream that has ended, after its last event has come."""
        if not query.isActive:
            with self.changed:
                if not self.changed.wait_for(lambda: str(query.runId) in self.ended, wait):
                    raise TimeoutError("the end of the stream was not reported")
        _, seen, late, all_seen, all_late = self.counts.get(str(query.id), (-1, 0, 0, 0, 0))
        return all_seen + seen, all_late + late


def dropped_rows(query: StreamingQuery) -> int:
    """Rows left out as too late, over the last batches (100 by default); ``LateRows`` counts over all."""
    return sum(
        int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators
    )


def run_to_end(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def rows_seen(query: StreamingQuery) -> int:
    return sum(int(p.numInputRows) for p in query.recentProgress)
