import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postbag.operators import ordered, quota
from postbag.sources.logs import setting_row

CASES = [
    (3, 0, [1, 1, 1, 1, 1, 1, 1], [0, 0, 0, 1, 1, 1, 2]),
    (3, 2, [1, 1, 1, 1, 1], [0, 1, 1, 1, 2]),
    (3, 3, [1, 1, 1, 1], [1, 1, 1, 2]),
    (3, 9, [1, 1], [1, 1]),
    (2, 0, [1, 0, 1, 1], [0, 0, 0, 1]),
]


def contacts(spark, rows):
    return spark.createDataFrame(rows, "run_id string, row_pos long, logged int")


@pytest.mark.parametrize("limit, sent, logged, days", CASES)
def test_plans(spark, limit, sent, logged, days):
    df = contacts(spark, [("r", i, c) for i, c in enumerate(logged)])
    planned = quota.plan_days(df, limit, sent, F.col("logged") == 1).orderBy("row_pos").collect()
    assert [r.send_day for r in planned] == days
    if all(logged):
        for dense in (False, True):
            planned = quota.plan_days(df, limit, sent, dense=dense).orderBy("row_pos").collect()
            assert [r.send_day for r in planned] == days


def day_by_day(rows, limit, sent):
    """The plan as a person would make it: fill a day with logged rows, then open the next."""
    days, left, day = [], max(limit - sent, 0), 0
    for logged in rows:
        if left == 0:
            day, left = day + 1, limit
        days.append(day)
        left -= logged
    return days


@pytest.mark.parametrize("shifts", [(2,), (1, 3), (2, 4, 7), ordered.SHIFTS])
def test_plans_against_a_model(spark, shifts):
    rng = random.Random(5)
    runs = {run: sorted(rng.sample(range(-500, 10_000), n)) for run, n in (("a", 300), ("b", 7), (None, 90))}
    rows = [(run, p, int(rng.random() < 0.7)) for run, ps in runs.items() for p in ps]
    shuffled = rng.sample(rows, len(rows))
    planned = quota.plan_days(contacts(spark, shuffled), 7, 3, F.col("logged") == 1, shifts=shifts)
    got = {(r.run_id, r.row_pos): r.send_day for r in planned.collect()}
    assert len(got) == len(rows)
    for run in runs:
        mine = [r for r in rows if r[0] == run]
        assert [got[run, r[1]] for r in mine] == day_by_day([r[2] for r in mine], 7, 3)
    used = defaultdict(int)
    for run, p, logged in rows:
        used[run, got[run, p]] += logged
    assert max(used.values()) <= 7


def test_no_row_is_lost_without_a_position(spark):
    df = contacts(spark, [("r", None, 1), ("r", 1, 1), ("r", 2, 1), (None, None, 1)])
    got = quota.plan_days(df, 1).collect()
    assert sorted((r.row_pos or -1, r.send_day) for r in got) == [(-1, None), (-1, None), (1, 0), (2, 1)]


def test_limits_must_be_positive(spark):
    df = contacts(spark, [("r", 0, 1)])
    for limit in (0, -1):
        with pytest.raises(ValueError):
            quota.plan_days(df, limit)
        with pytest.raises(Exception, match="must be positive"):
            quota.plan_days(df, F.lit(limit)).collect()


def test_positions_and_slices(spark):
    df = contacts(spark, [("a", 5, 0), ("a", 900, 0), ("b", 3, 0), ("a", 7, 0)])
    df = df.withColumnRenamed("row_pos", "id")
    got = {(r.run_id, r.id): r.row_pos for r in ordered.row_position(df, ["run_id"], "id", shifts=(1, 3)).collect()}
    assert got == {("a", 5): 0, ("a", 7): 1, ("a", 900): 2, ("b", 3): 0}
    page = ordered.slice_rows(ordered.row_position(df, ["run_id"], "id"), 1, 1)
    assert [r.id for r in page.collect()] == [7]


def settings_log(spark, *writes):
    out = setting_row(spark, "other", 7, F.lit("2030-01-01").cast("timestamp_ntz"))
    for i, (value, ts) in enumerate(writes):
        out = out.unionByName(setting_row(spark, "daily_limit", value, F.lit(ts).cast("timestamp_ntz"), i))
    return out


@pytest.mark.parametrize(
    "writes, want",
    [
        ([], 100),
        ([("25", "2024-01-01")], 25),
        ([("25", "2024-01-02"), ("30", "2024-01-01")], 25),
        ([("25", "2024-01-01"), ("30", "2024-01-01")], 30),
        ([("abc", "2024-01-01")], 100),
    ],
)
def test_settings(spark, writes, want):
    setting = quota.get_setting(settings_log(spark, *writes))
    assert [r.value for r in setting.collect()] == [want]
    with_limit = quota.with_setting(contacts(spark, [("r", 0, 1), ("r", 1, 1)]), setting)
    assert [r.daily_limit for r in with_limit.collect()] == [want, want]


def test_counts_by_zone(spark):
    log = spark.createDataFrame(
        [("2024-01-15 22:59:59", "Sent"), ("2024-01-15 23:00:00", "Failed"), ("2024-01-16 00:00:00", "Sent")],
        "t string, status string",
    ).select(F.col("t").cast("timestamp_ntz").alias("ts"), "status")
    day = dt.date(2024, 1, 16)
    for source in (log, log.withColumn("day", F.to_date("ts"))):
        assert quota.sent_today(source, day).first().sent == 1
        assert quota.sent_today(source, day, "CET").first().sent == 2
        assert quota.sent_today(source, day, "CET", ["Sent"]).first().sent == 1
        assert quota.sent_today(source, dt.date(2020, 1, 1)).first().sent == 0
    assert {r.day.day: r.sent for r in quota.daily_counts(log, "CET").collect()} == {15: 1, 16: 2}
    assert quota.row_count(log).first().rows == 3
