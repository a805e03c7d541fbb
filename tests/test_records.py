"""Records split by quotes over blocks, against Python's CSV reader and the one-task reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from postbag.sources.contacts import load_each, load_lines, read_contacts, read_split_contacts
from postbag.sources.records import UNCLOSED, split_records, text_lines
from postbag.streaming.sinks import contact_sink, read_contact_sink, run_to_end

HEADER = "Person Linkedin Url,Email,First Name,Last Name,Company"


def at():
    return F.lit("2024-01-15 03:30:00").cast("timestamp_ntz")


FIELDS = ["file_name", "row_pos", "profile_url", "email", "first_name", "last_name", "company", "error"]


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def awkward(r, width, n, eol="\n"):
    cells = ["a", "", '"q, x"', '"line\nbreak ""quoted"""', '"\n\n"', '"x\ny"', "None", '"é\nß, ""\n"', '""', '","']
    return "".join(
        ",".join(r.choice(cells) for _ in range(r.choice([width] * 8 + [width - 1, width + 1]))) + r.choice("\n\n\v").replace("\v", "\n\n")
        for _ in range(n)
    ).replace("\n", eol)


def write(path, text):
    path.write_bytes(text.encode())


def test_records_are_those_of_a_csv_reader(spark, tmp_path, small_blocks):
    text = HEADER + "\n" + awkward(random.Random(1), 5, 4000)
    write(tmp_path / "a.csv", text)
    lines = text_lines(spark, str(tmp_path))
    assert lines.select("_start").distinct().count() > 10
    got = [r._record for r in split_records(lines).orderBy("_rec").collect()]
    want = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
    assert [next(csv.reader(io.StringIO(x, newline=""))) for x in got] == want


def test_same_as_the_reader_by_one_task(spark, tmp_path, small_blocks):
    r = random.Random(2)
    layouts = [HEADER, "Company,Note," + HEADER[: HEADER.rindex(",")], "﻿" + HEADER + ",X", 'Email,"Person Linkedin Url"']
    for k, header in enumerate(layouts):
        eol = "\r\n" if k == 1 else "\n"
        write(tmp_path / f"f{k}.csv", header + eol + awkward(r, header.count(",") + 1, 700, eol))
    (tmp_path / "empty.csv").write_text("")
    one, two = (read(spark, str(tmp_path)).select(*FIELDS).collect() for read in (read_contacts, read_split_contacts))
    assert {tuple(x)[:7] for x in one} == {tuple(x)[:7] for x in two} and len(one) == len(two)
    assert {x.row_pos for x in one if x.error} == {x.row_pos for x in two if x.error} and len(two) > 2000
    contacts, runs = load_lines(text_lines(spark, str(tmp_path)), at())
    other, log = load_each(spark, str(tmp_path), at())
    key = ["run_id", *FIELDS[1:7]]
    assert sorted(map(str, contacts.select(key).collect())) == sorted(map(str, other.select(key).collect()))
    assert sorted(map(str, runs.collect())) == sorted(map(str, log.collect())) and runs.count() == 4


def test_no_task_has_a_whole_file(spark, tmp_path, small_blocks):
    write(tmp_path / "a.csv", HEADER + "\n" + 'u,,a,b,"c\nd"\n' * 4000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    plan = read_split_contacts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "SinglePartition" not in plan.split("Sort [file_name")[0]
    lines = text_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 8 and before
    assert read_split_contacts(spark, str(tmp_path)).where("company = 'c\nd'").count() == 4000


def test_a_quote_that_is_never_closed(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER + "\nu1,,,,x\nu2,\"" + "open\n" * 50)
    rows = split_records(text_lines(spark, str(tmp_path)), max_lines=20).collect()
    assert sum(r._unclosed == UNCLOSED for r in rows) == 50 and sum(r._unclosed is None for r in rows) == 2
    short = split_records(text_lines(spark, str(tmp_path))).orderBy("_rec").collect()
    assert len(short) == 3 and short[2]._record.count("\n") == 49


def test_missing_columns_and_nothing_at_all(spark, tmp_path):
    write(tmp_path / "a.csv", "Email,Company\nx,y\n")
    with pytest.raises(ValueError):
        read_split_contacts(spark, str(tmp_path))
    contacts, runs = load_lines(text_lines(spark, str(tmp_path)), at())
    assert contacts.count() == 0 and [r.status for r in runs.collect()] == ["Error"]
    write(tmp_path / "a.csv", "")
    with pytest.raises(ValueError):
        read_split_contacts(spark, str(tmp_path))


def test_stream_of_mixed_files(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    seen = []
    drops = [
        {"a.csv": HEADER + '\nu1,,,,"x\ny"\n', "bad.csv": "Email\nz\n"},
        {"b.csv": "Company,Person Linkedin Url\nacme,u2\n", "c.csv": "Person Linkedin Url\nu3\nu4,more\n"},
        {"d.csv": HEADER + "\nu5,e@x\n"},
    ]
    for files in drops:
        for name, text in files.items():
            write(inbox / name, text)
        run_to_end(contact_sink(spark, str(inbox), out, out + "-checkpoint", at(), maxFilesPerTrigger=1))
        contacts, runs = read_contact_sink(spark, out)
        seen.append((contacts.count(), runs.where("status = 'Error'").count(), runs.count()))
    assert seen == [(1, 1, 2), (4, 1, 4), (5, 1, 5)]
    got = {r.profile_url: (r.company, r.email, r.error) for r in contacts.collect()}
    assert got == {"u1": ("x\ny", None, None), "u2": ("acme", None, None), "u3": (None,) * 3, "u4": (None, None, "u4,more"), "u5": (None, "e@x", None)}
    # a batch that is run again replaces its folders
    run_to_end(contact_sink(spark, str(inbox), out, out + "-again", at(), maxFilesPerTrigger=1))
    assert read_contact_sink(spark, out)[0].count() == 5
