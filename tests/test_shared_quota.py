"""One limit over all runs, and limits that change from day to day, against a loop over sorted rows."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postbag import workspace
from postbag.operators import ordered, quota
from postbag.plans.outbox import schedule
from postbag.sources.logs import put_setting

NOW = "2024-01-15 03:30:00"
STARTS = {"a": 2, "b": 1, "c": 1, None: 0}


def sending_order(row):
    run, pos, name = row[:3]
    started = STARTS.get(run) if run is not None else None
    return (started is None, started or 0, run is None, run or "", pos is None, pos or 0, name)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for run, n in (("a", 400), ("b", 50), ("c", 120), ("gone", 30), (None, 20)):
        for k in range(n):
            out.append((run, r.choice([None, 0, 0, 0, r.randrange(20)]), f"{run}{k:04}", r.random() < 0.7))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def tables(spark, rows):
    contacts = spark.createDataFrame(rows, "run_id string, row_pos long, profile_url string, uses boolean").repartition(6)
    runs = spark.createDataFrame([(k, v) for k, v in STARTS.items() if k] + [("a", 9)], "run_id string, started int")
    return contacts, runs


def used_before(rows, every=False):
    out, used = {}, 0
    for row in sorted(rows, key=sending_order):
        out[row[2]] = used
        used += every or row[3]
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_one_limit_over_all_runs(spark, rows, tables, partitions):
    contacts, runs = tables
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for consumes in (None, F.col("uses")):
            got = quota.plan_shared(contacts, runs, 7, 3, consumes, tie=["profile_url"]).collect()
            ahead = used_before(rows, consumes is None)
            assert {r.profile_url: r.send_day for r in got} == {k: (3 + v) // 7 for k, v in ahead.items()}
            load = Counter(r.send_day for r in got if consumes is None or r.uses)
            assert len(got) == len(rows) and max(load.values()) <= 7 and load[0] <= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_rows_alike_in_everything_are_planned_one_by_one(spark):
    same = spark.createDataFrame([("a", None, "x")] * 50, "run_id string, row_pos long, profile_url string")
    runs = spark.createDataFrame([], "run_id string, started int")
    load = Counter(r.send_day for r in quota.plan_shared(same, runs, 4).collect())
    assert load == Counter({d: 4 for d in range(12)} | {12: 2})
    assert quota.plan_shared(same.where("false"), runs, 4).count() == 0


def test_one_position_is_spread_over_parts(spark):
    rows = spark.range(40_000).selectExpr("'a' run_id", "7L row_pos", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        parted, parts = ordered.ranged_sum(rows, [F.col("run_id"), F.col("row_pos")], None, "ahead")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in parted.groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 15_000 and parts.count() == len(sizes)
    assert parted.agg(F.min("ahead"), F.max("ahead"), F.countDistinct("ahead")).first()[:] == (0, 39_999, 40_000)


def log_of(spark, *writes):
    path = workspace.fresh(spark, "settings")
    spark.createDataFrame([], "key string, value string, ts timestamp_ntz, seq long").write.parquet(path)
    for seq, (value, ts) in enumerate(writes):
        put_setting(spark, path, "daily_limit", value, F.lit(ts).cast("timestamp_ntz"), seq)
    put_setting(spark, path, "other", 1, F.lit(NOW).cast("timestamp_ntz"))
    return spark.read.parquet(path)


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def room_of(spark, *writes, sent=None):
    return [tuple(r) for r in quota.daily_room(log_of(spark, *writes), at(NOW), sent).orderBy("day_no").collect()]


def test_room_of_days(spark):
    day = dt.date(2024, 1, 15)
    assert room_of(spark) == [(0, day, 100, 100, 0)]
    assert room_of(spark, ("5", NOW)) == [(0, day, 5, 5, 0)]
    # 04:00 UTC is 05:00 in the sending zone, the moment the day opens; a second later is the next day
    got = room_of(spark, ("5", "2024-01-01"), ("9", "2024-01-16 04:00:00"), ("x", "2024-01-16 04:00:01"), ("2", "2024-01-18 04:00:01"))
    assert [r[2:] for r in got] == [(5, 5, 0), (9, 9, 5), (100, 100, 14), (100, 100, 114), (2, 2, 214)]
    got = room_of(spark, ("6", "2024-01-15 03:30:01"))  # after now, before day 0 is over: from day 1 on
    assert [r[2] for r in got] == [100, 6]
    sent = spark.createDataFrame([(day, 4), (day + dt.timedelta(2), 50), (day - dt.timedelta(1), 7)], "day date, sent long")
    got = room_of(spark, ("5", "2024-01-01"), sent=sent)
    assert [r[2:] for r in got] == [(5, 1, 0), (5, 5, 1), (5, 0, 6), (5, 5, 6)]


def day_by_day(rows, rooms, every):
    """Fill the days in turn; ``rooms`` are followed by the last one for ever."""
    out, day, left = {}, 0, rooms[0]
    for row in sorted(rows, key=sending_order):
        while left <= 0:
            day += 1
            left = rooms[min(day, len(rooms) - 1)]
            if day > len(rooms) and left <= 0:
                day = None
                break
        out[row[2]] = day
        if day is None:
            left = -1
            day = len(rooms)
            continue
        left -= 1 if every else row[3]
    return out


@pytest.mark.parametrize("last", ["9", "0", "-3"])
@pytest.mark.parametrize("every", [True, False])
def test_a_limit_that_changes(spark, rows, tables, last, every):
    contacts, runs = tables
    settings = log_of(spark, ("40", "2024-01-01"), ("0", "2024-01-16"), ("25", "2024-01-18"), ("70", "2024-01-20 10:00:00"), (last, "2024-01-23"))
    sent = spark.createDataFrame([(dt.date(2024, 1, 15), 33), (dt.date(2024, 1, 19), 99)], "day date, sent long")
    room = quota.daily_room(settings, at(NOW), sent)
    rooms = [r.room for r in room.orderBy("day_no").collect()]
    assert rooms == [7, 0, 0, 25, 0, 25, 70, 70, max(int(last), 0)]
    planned = quota.plan_by_room(contacts, runs, room, None if every else F.col("uses"), tie=["profile_url"])
    got = {r.profile_url: r.send_day for r in planned.collect()}
    assert got == day_by_day(rows, rooms, every)
    assert (None in got.values()) == (last != "9")


def test_no_pairs_in_a_plan_by_room(spark, tables):
    contacts, runs = tables
    room = quota.daily_room(log_of(spark, ("40", "2024-01-01"), ("9", "2024-01-20")), at(NOW))
    text = quota.plan_by_room(contacts, runs, room)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "hashpartitioning(_part" in text


def test_schedule_shares_the_limit(spark, tables):
    contacts, runs = tables
    people = contacts.selectExpr("*", "'m@x.example' email", "'A' first_name", "'B' last_name", "'C' company")
    planned = schedule(people, at(NOW), 50, runs=runs)
    assert max(r["count"] for r in planned.groupBy("send_day").count().collect()) == 50
    room = quota.daily_room(log_of(spark, ("50", "2024-01-01"), ("10", "2024-01-16")), at(NOW))
    load = Counter(r.send_day for r in schedule(people, at(NOW), room, runs=runs).collect())
    assert load[0] == 50 and set(load.values()) - {50} == {10}
    with pytest.raises(ValueError):
        schedule(people, at(NOW), room)
