import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from postbag.functions import clock

UTC = ZoneInfo("UTC")


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def hours(spark, year):
    start = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")
    return spark.range(0, 8784, 1, 4).select(
        (start + F.make_dt_interval(hours=F.col("id"))).alias("ts")
    )


def local(ts, name):
    return ts.replace(tzinfo=UTC).astimezone(ZoneInfo(name))


def test_every_hour_of_a_year(spark, zone):
    rows = hours(spark, 2024).select(
        "ts",
        clock.next_window_start(F.col("ts")).alias("next"),
        clock.to_zone(F.col("ts"), "CET").alias("local"),
        clock.day_of(F.col("ts"), "CET").alias("day"),
        clock.micros_of(F.col("ts")).alias("micros"),
        F.unix_micros(clock.utc_instant(F.col("ts"))).alias("instant"),
        clock.send_after(F.col("ts"), F.lit(3)).alias("third"),
    )
    for r in rows.collect():
        here = local(r.ts, "CET")
        day = here.date() + dt.timedelta(days=1 if here.hour >= 5 else 0)
        want = dt.datetime(day.year, day.month, day.day, 5, tzinfo=ZoneInfo("CET")).astimezone(UTC)
        assert r.next == want.replace(tzinfo=None), r
        assert r.local == here.replace(tzinfo=None)
        assert r.day == here.date()
        micros = int(r.ts.replace(tzinfo=UTC).timestamp()) * 1_000_000
        assert r.micros == micros and r.instant == micros
        third = here.date() + dt.timedelta(days=3)
        opens = dt.datetime(third.year, third.month, third.day, 5, tzinfo=ZoneInfo("CET")).astimezone(UTC)
        assert r.third == opens.replace(tzinfo=None)


@pytest.mark.parametrize(
    "now, want",
    [
        ("2024-01-10 03:59:59", "2024-01-10 04:00:00"),
        ("2024-01-10 04:00:00", "2024-01-11 04:00:00"),
        ("2024-07-10 02:30:00", "2024-07-10 03:00:00"),
        ("2024-03-30 12:00:00", "2024-03-31 03:00:00"),
        ("2024-10-26 12:00:00", "2024-10-27 04:00:00"),
    ],
)
def test_windows(spark, now, want):
    ts = F.lit(now).cast("timestamp_ntz")
    start = clock.next_window_start(ts)
    row = spark.range(1).select(
        start.alias("s"), clock.seconds_until(ts, start).alias("w"), clock.send_after(ts, F.lit(0)).alias("a")
    ).first()
    assert row.s == dt.datetime.fromisoformat(want)
    assert row.w == (dt.datetime.fromisoformat(want) - dt.datetime.fromisoformat(now)).total_seconds()
    assert row.a == dt.datetime.fromisoformat(now)


def test_day_bounds_fold(spark, zone):
    start, end = clock.day_bounds(dt.date(2024, 3, 31), "CET")
    row = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    assert (row.s, row.e) == (dt.datetime(2024, 3, 30, 23), dt.datetime(2024, 3, 31, 22))
