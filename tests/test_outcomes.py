import datetime as dt

from pyspark.sql import functions as F

from postbag import schema as S
from postbag.operators.outcomes import (
    classify_message,
    classify_run,
    isolate_errors,
    unfinished_runs,
)

EVIDENCE = (
    "error string, profile_id string, no_recipient boolean, review boolean, pressed string, "
    "send_disabled boolean, attempted boolean"
)
MESSAGES = [
    (("boom", "p", None, None, None, None, True), ("Failed", "boom", True)),
    ((None, None, True, None, None, None, True), ("Failed", "Profile ID extraction failed.", True)),
    ((None, "p", True, True, None, None, True), (None, None, False)),
    ((None, "p", None, True, "Backspace", None, True), ("Skipped", "User skipped sending.", True)),
    ((None, "p", None, True, "Shift", None, True), ("Failed", "Unrecognized key press.", True)),
    ((None, "p", None, True, None, None, True), ("Failed", "Timeout waiting for user input.", True)),
    ((None, "p", None, True, "Enter", True, True), ("Failed", "Send button disabled.", True)),
    ((None, "p", None, True, "Enter", None, True), ("Ready", None, True)),
    ((None, "p", None, False, None, False, True), ("Ready", None, True)),
    (("boom", "p", None, None, None, None, False), ("Not attempted", None, False)),
]


def test_messages(spark):
    df = spark.createDataFrame([(i, *e) for i, (e, _) in enumerate(MESSAGES)], "i int, " + EVIDENCE)
    verdict = classify_message(*[F.col(c.split()[0]) for c in EVIDENCE.split(", ")]).alias("v")
    got = [tuple(r.v) for r in df.select("i", verdict).orderBy("i").collect()]
    assert got == [want for _, want in MESSAGES]


RUNS = [
    ((3, 3, True, "bad file", None, None, None), (S.ERROR, "bad file")),
    ((3, 0, True, None, "no browser", None, None), (S.FAILED, S.RUN_STARTUP_PREFIX + "no browser")),
    ((3, 1, True, None, None, True, "x"), (S.INTERRUPTED, S.RUN_INTERRUPTED)),
    ((3, 1, True, None, None, None, "x"), (S.FAILED, S.RUN_UNEXPECTED_PREFIX + "x")),
    ((3, 3, None, None, None, None, None), (S.COMPLETED, S.RUN_COMPLETED)),
    ((3, 2, True, None, None, None, None), (S.FAILED, S.RUN_ENDED)),
    ((3, 2, None, None, None, None, None), (S.RUNNING, None)),
]
RUN = (
    "total int, attempted int, ended boolean, rejected string, startup_error string, "
    "interrupted boolean, unexpected_error string"
)


def test_runs(spark):
    df = spark.createDataFrame([(i, *e) for i, (e, _) in enumerate(RUNS)], "i int, " + RUN)
    state = classify_run(*[F.col(c.split()[0]) for c in RUN.split(", ")]).alias("s")
    assert [tuple(r.s) for r in df.select("i", state).orderBy("i").collect()] == [w for _, w in RUNS]
    plain = classify_run(F.col("total"), F.col("attempted"), F.col("ended")).alias("s")
    assert df.select("i", plain).orderBy("i").first().s.status == S.COMPLETED


def test_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([("1", "x"), ("?", None)], "cell string, body string")
    df = df.withColumn("n", F.col("cell").try_cast("int"))
    checks = {"not a number": F.col("n").isNull(), "small": F.col("n") < 5}
    once = isolate_errors(df, checks)
    assert [(r.error, r.body) for r in once.collect()] == [("small", "x"), ("not a number", "")]
    twice = isolate_errors(once, {"late": F.lit(True)})
    assert [r.error for r in twice.collect()] == ["small", "not a number"]


def test_unfinished(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("a", "Running", t), ("b", "Completed", t), ("c", "Running", t + dt.timedelta(days=9))],
        "run_id string, status string, ts timestamp_ntz",
    )
    got = unfinished_runs(df, F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")).collect()
    assert [(r.run_id, r.open_seconds) for r in got] == [("a", 60.0)]
