import datetime as dt
import random

import pytest

from postbag.operators.decisions import await_decision, parse_key_log

T0 = dt.datetime(2024, 1, 1)
DRAFTS = "message_id string, ts timestamp_ntz, note string"
KEYS = "message_id string, ts timestamp_ntz, key string, press_id long"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_cases(spark):
    drafts = spark.createDataFrame([(m, T0, m.upper()) for m in "abcdefghi"], DRAFTS)
    keys = spark.createDataFrame(
        [
            ("a", at(10), "Enter", 1),
            ("b", at(10), "Backspace", 2),
            ("c", at(10), "Shift", 3),
            ("d", at(300), "Enter", 4),
            ("e", at(300.000001), "Enter", 5),
            ("f", at(20), "Enter", 6),
            ("f", at(10), "Backspace", 7),
            ("g", at(-5), "Enter", 8),
            ("g", at(0), "Enter", 9),
            ("h", at(1), "x", 10),
            ("h", at(2), "Enter", 11),
            (None, at(2), "Enter", 12),
            ("zz", at(2), "Enter", 13),
        ],
        KEYS,
    )
    got = {r.message_id: (r.pressed, r.decision, r.note) for r in await_decision(drafts, keys).collect()}
    assert got == {
        "a": ("Enter", "go", "A"),
        "b": ("Backspace", "skip", "B"),
        "c": ("Shift", "unrecognized", "C"),
        "d": ("Enter", "go", "D"),
        "e": (None, None, "E"),
        "f": ("Backspace", "skip", "F"),
        "g": (None, None, "G"),
        "h": ("Enter", "go", "H"),
        "i": (None, None, "I"),
    }


@pytest.mark.parametrize("shifts", [(28,), (20,), (22, 30)])
def test_against_all_pairs(spark, shifts):
    """Two thirds of everything under one id, many equal times, and drafts without id or time."""
    rng = random.Random(3)

    def name():
        return rng.choice(["hot", "hot", "b", None])

    drafts = [(name(), at(rng.randrange(2000)), str(i)) for i in range(300)] + [("hot", None, "late")]
    keys = [(name(), at(rng.randrange(2000)), rng.choice(["Enter", "Shift", "x"]), i) for i in range(300)]
    got = await_decision(
        spark.createDataFrame(drafts, DRAFTS), spark.createDataFrame(keys, KEYS), tie="press_id", timeout=40, shifts=shifts
    )
    want = []
    for message, ts, note in drafts:
        hits = [
            (t, i, k)
            for m, t, k, i in keys
            if k != "x" and m is not None and m == message and ts is not None and ts < t <= ts + dt.timedelta(seconds=40)
        ]
        first = min(hits, default=(None, None, None))
        want.append((note, first[0], first[2]))
    assert sorted((r.note, r.decided_at, r.pressed) for r in got.collect()) == sorted(want)


def test_key_log(spark):
    log = "2024-01-01T00:00:00.000Z: Enter\n2024-01-01T00:00:01.5Z: a\nno time: x\n\n2024-01-01T00:00:02Z: : \n"
    df = spark.createDataFrame([("m", log), ("n", "")], "message_id string, key_log string")
    got = [(r.message_id, r.line, r.ts, r.key) for r in parse_key_log(df).orderBy("line").collect()]
    assert got == [("m", 0, at(0), "Enter"), ("m", 1, at(1.5), "a"), ("m", 4, at(2), ": ")]
