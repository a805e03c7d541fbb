import datetime as dt

from pyspark.sql import functions as F

from postbag import schema as S
from postbag import workspace
from postbag.operators.history import latest_by_key
from postbag.plans.stream_queries import decisions_stream
from postbag.streaming import sinks, sources
from postbag.streaming.operators import stream_daily_counts, stream_decisions

EVENTS = "event_id long, ts timestamp_ntz, kind string"


def rows(spark, *cells):
    return spark.createDataFrame([(i, dt.datetime.fromisoformat(t), k) for i, t, k in cells], EVENTS)


def schema(spark):
    return rows(spark).schema


def test_counts_go_on_after_a_restart_and_leave_late_rows_out(spark):
    inbox, out = workspace.fresh(spark, "inbox"), workspace.fresh(spark, "counts")

    def run():
        stream = sources.with_event_time(sources.stream_table(spark, inbox, schema(spark)), delay="1 hour")
        return sinks.run_to_end(sinks.append_sink(stream_daily_counts(stream), out, out + "-checkpoint"))

    def counts():
        return {r.day.day: r.sent for r in spark.read.parquet(out).collect()}

    rows(spark, (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-03 00:30:00", "a")).write.parquet(inbox)
    run()
    assert counts() == {1: 1}
    late = rows(spark, (3, "2024-01-01 11:00:00", "a"), (4, "2024-01-02 23:45:00", "a"), (5, "2024-01-04 02:00:00", "a"))
    late.write.mode("append").parquet(inbox)
    query = run()
    assert sinks.dropped_rows(query) == 1 and sinks.rows_seen(query) == 3
    assert counts() == {1: 1, 2: 1, 3: 1}
    run()
    assert counts() == {1: 1, 2: 1, 3: 1}


def test_late_rows_are_counted_over_all_batches_and_restarts(spark):
    inbox, out = workspace.fresh(spark, "inbox"), workspace.fresh(spark, "counts")
    listener = sinks.LateRows()
    spark.streams.addListener(listener)
    try:

        def run(batches):
            for values in batches:
                rows(spark, *values).coalesce(1).write.mode("append").parquet(inbox)
            stream = spark.readStream.schema(schema(spark)).option("maxFilesPerTrigger", 1).parquet(inbox)
            counts = stream_daily_counts(sources.with_event_time(stream, delay="1 hour"))
            return sinks.run_to_end(sinks.append_sink(counts, out, out + "-checkpoint"))

        # a batch is judged by the mark of the one before the last
        first = run([[(1, "2024-01-05 10:00:00", "a")], [(5, "2024-01-05 10:30:00", "a")], [(2, "2024-01-01 10:00:00", "a")]])
        assert listener.of(first) == (3, 1)
        again = run([[(3, "2024-01-01 10:00:00", "a")], [(4, "2024-01-05 11:00:00", "a")]])
        assert again.id == first.id and listener.of(again) == (5, 2)
        plain, done = workspace.fresh(spark, "many"), workspace.fresh(spark, "copied")
        spark.range(0, 110, 1, 110).write.parquet(plain)
        many = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(plain)
        query = many.writeStream.option("checkpointLocation", done + "-checkpoint").trigger(availableNow=True).start(done, "parquet")
        sinks.run_to_end(query)
        assert listener.of(query) == (110, 0) and sinks.rows_seen(query) < 110
    finally:
        spark.streams.removeListener(listener)


def test_running_counts_hold_the_open_day(spark):
    inbox, out = workspace.fresh(spark, "inbox"), workspace.fresh(spark, "counts")

    def run():
        stream = sources.with_event_time(sources.stream_table(spark, inbox, schema(spark)))
        counts = stream_daily_counts(stream)
        sinks.run_to_end(sinks.upsert_sink(counts, out, out + "-checkpoint"))
        return {r.day.day: r.sent for r in sinks.read_upserts(spark, out, counts.schema, ["day"]).collect()}

    rows(spark, (1, "2024-01-01 10:00:00", "a")).write.parquet(inbox)
    assert run() == {1: 1}
    rows(spark, (2, "2024-01-01 10:00:01", "a"), (3, "2024-01-02 00:00:00", "a")).write.mode("append").parquet(inbox)
    assert run() == {1: 2, 2: 1}


def test_status_changes_replay_to_the_same_state(spark):
    inbox, out = workspace.fresh(spark, "inbox"), workspace.fresh(spark, "states")
    rows(spark, (1, "2024-01-01", "Running"), (3, "2024-01-01", "Completed")).write.parquet(inbox)

    def run(checkpoint):
        changes = sources.stream_table(spark, inbox, schema(spark)).select(
            F.lit("r").alias("run_id"), F.col("event_id").alias("seq"), F.col("kind").alias("status")
        )
        sinks.run_to_end(sinks.stream_run_status(changes, out, checkpoint))
        return [tuple(r) for r in sinks.read_upserts(spark, out, changes.schema, ["run_id"], ["seq"]).collect()]

    assert run(out + "-c1") == [("r", 3, "Completed")]
    rows(spark, (2, "2024-01-01", "Failed")).write.mode("append").parquet(inbox)
    assert run(out + "-c1") == [("r", 3, "Completed")]
    assert run(out + "-c2") == [("r", 3, "Completed")]


def test_compaction_changes_nothing(spark):
    inbox, out = workspace.fresh(spark, "inbox"), workspace.fresh(spark, "states")

    def arrive(*cells):
        rows(spark, *cells).write.mode("append").parquet(inbox)
        stream = sources.stream_table(spark, inbox, schema(spark))
        sinks.run_to_end(sinks.stream_run_status(stream, out, out + "-c", ["kind"], ["event_id"]))

    def state(base=None):
        read = sinks.read_upserts(spark, out, schema(spark), ["kind"], ["event_id"], base)
        return sorted((r.kind, r.event_id) for r in read.collect())

    arrive((1, "2024-01-01", "a"), (5, "2024-01-01", "b"))
    arrive((4, "2024-01-01", "b"), (6, "2024-01-01", "a"))
    sinks.compact_upserts(spark, out, schema(spark), ["kind"], out + "-base", ["event_id"])
    assert state(out + "-base") == state() == [("a", 6), ("b", 5)]
    arrive((7, "2024-01-01", "b"), (2, "2024-01-01", "c"))
    assert state(out + "-base") == state() == [("a", 6), ("b", 7), ("c", 2)]
    sinks.compact_upserts(spark, out, schema(spark), ["kind"], out + "-base2", ["event_id"], out + "-base")
    assert state(out + "-base2") == [("a", 6), ("b", 7), ("c", 2)]


def test_one_file_or_a_folder(spark, sf):
    for path in (f"{sf}/events.parquet", workspace.keep(spark.read.parquet(f"{sf}/events.parquet"), "e").inputFiles()[0].rsplit("/", 1)[0]):
        table = spark.read.parquet(path)
        out = workspace.fresh(spark, "copied")
        sinks.run_to_end(sinks.append_sink(sources.stream_table(spark, path, table.schema), out, out + "-checkpoint"))
        assert spark.read.parquet(out).exceptAll(table).count() == 0 and spark.read.parquet(out).count() == 1000


def test_contact_files_as_they_arrive(spark, tmp_path):
    header = ",".join(S.CONTACT_HEADERS) + "\n"
    (tmp_path / "a.csv").write_text(header + 'u1,NA,Bo,Ray,"A\nB"\nu2,x@y,,,\n')
    out = workspace.fresh(spark, "arrived")

    def run():
        stream = sources.stream_contacts(spark, str(tmp_path))
        sinks.run_to_end(sinks.append_sink(stream, out, out + "-checkpoint"))
        return sorted((r.file_name[-5:], r.profile_url, r.email, r.company) for r in spark.read.parquet(out).collect())

    first = [("a.csv", "u1", None, "A\nB"), ("a.csv", "u2", "x@y", None)]
    assert run() == first
    (tmp_path / "b.csv").write_text(header + "u3,z@y,,,C\n")
    assert run() == [*first, ("b.csv", "u3", "z@y", "C")]


def test_latest_is_the_same_in_batch_and_stream(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = workspace.fresh(spark, "states")
    stream = sources.stream_table(spark, f"{sf}/events.parquet", events.schema, maxFilesPerTrigger=1)
    sinks.run_to_end(sinks.stream_run_status(stream, out, out + "-c", ["user_id"], ["event_id"]))
    streamed = sinks.read_upserts(spark, out, events.schema, ["user_id"], ["event_id"])
    batch = latest_by_key(events, ["user_id"], ["event_id"])
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_decisions_are_exact_and_their_state_is_freed(spark):
    drafts, presses, out = (workspace.fresh(spark, n) for n in ("drafts", "presses", "decided"))
    shapes = "message_id string, ts timestamp_ntz", "message_id string, ts timestamp_ntz, key string"

    def arrive(new_drafts, new_presses):
        for path, shape, cells in ((drafts, shapes[0], new_drafts), (presses, shapes[1], new_presses)):
            day = [(i, dt.datetime.fromisoformat("2024-01-01T" + t), *more) for i, t, *more in cells]
            spark.createDataFrame(day, shape).coalesce(1).write.mode("append").parquet(path)
        streams = [
            sources.with_event_time(sources.stream_table(spark, p, spark.createDataFrame([], s).schema), delay="10 seconds")
            for p, s in zip((drafts, presses), shapes)
        ]
        query = sinks.run_to_end(sinks.append_sink(stream_decisions(*streams), out, out + "-c"))
        got = spark.read.parquet(out).collect()
        return {r.message_id: (r.pressed, r.decision) for r in got}, query.lastProgress.stateOperators[0].numRowsTotal

    end = [("end", "10:20:00")]
    got, _ = arrive(
        [("a", "10:00:00"), ("b", "10:00:00.000001"), ("c", "10:00:00"), ("e", "10:00:05"), (None, "10:00:00")],
        [("a", "10:05:00", "Enter"), ("b", "10:00:00.000001", "Enter"), ("c", "10:05:00.000001", "Enter"), ("e", "10:00:07", "x"), ("d", "10:04:58", "Enter"), (None, "10:00:01", "Enter")],
    )
    assert got == {}  # the mark of the drafts is behind
    got, _ = arrive([("d", "10:04:57")], [("a", "10:04:59", "Backspace"), ("b", "10:05:00.000001", "Backspace")])
    assert got == {}
    got, _ = arrive(end, [("end", "10:06:00", "Backspace")])
    assert got == {"a": ("Backspace", "skip"), "b": ("Backspace", "skip"), "c": (None, None), "d": ("Enter", "go"), "e": (None, None)}
    got, kept = arrive([("z", "11:00:00")], [("z", "11:00:00.5", "Enter"), ("a", "11:00:00", "Enter")])
    assert len(got) == 6 and got["end"] == (None, None)
    got, kept = arrive([("q", "12:00:00")], [("q", "12:30:00", "Enter")])
    assert len(got) == 7 and got["z"] == ("Enter", "go") and kept <= 2


def test_every_order_is_decided_or_timed_out_by_the_end_of_the_stream(spark, tmp_path):
    def at(text):
        return text and dt.datetime.fromisoformat(text)

    orders = [(1, "1850-01-01"), (2, "1997-02-20"), (3, "2024-01-01"), (4, "2024-01-30"), (5, "2250-01-01"), (6, None)]
    lines = [(1, "1850-01-02"), (2, "1997-03-05"), (3, "2024-02-01"), (4, "2024-02-29"), (5, "2250-01-02"), (6, "2024-01-01"), (7, None)]
    spark.createDataFrame([(i, at(t)) for i, t in orders], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        [(i, at(t), "F", "A") for i, t in lines], "l_orderkey long, l_shipdate timestamp_ntz, l_linestatus string, l_returnflag string"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.message_id: (r.drafted_at, r.decided_at, r.decision) for r in decisions_stream(spark, str(tmp_path)).collect()}
    answered = {1: "1850-01-02", 2: "1997-03-05", 4: "2024-02-29", 5: "2250-01-02"}
    assert got == {i: (at(t), at(answered.get(i)), "go" if i in answered else None) for i, t in orders}
