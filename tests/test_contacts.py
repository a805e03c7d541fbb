import datetime as dt

import pytest
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.operators.addresses import resolve_address, with_address
from postbag.operators.quota import plan_days
from postbag.sources.contacts import load_each, load_or_reject, read_contacts, read_raw, require_columns

HEADER = "Person Linkedin Url,Email,First Name,Last Name,Company\n"
ROWS = (
    "u1,ann@x.org,Ann,Lee,X\n"
    'u2,,Bo,Ray,"Acme, Inc."\n'
    "u3,,Bo,Ray,A  B & Co\n"
    "u4,,Zoë,Groß,Müller GmbH\n"
    "u5,None,Al,Fox,Y\n"
    "u6,,Al,NA,Y\n"
    "u7,,Al,Fox,\n"
    'u8,"  ",Al,Fox,Y\n'
    'u9,,Al,Fox,"Acme\n""X"", Inc"\n'
    "u10,,Al,Fox,360\n"
)
WANT = {
    "u1": "ann@x.org",
    "u2": "bo.ray@acme-inc.com",
    "u3": "bo.ray@a--b--co.com",
    "u4": "zoë.groß@müller-gmbh.com",
    "u5": "al.fox@y.com",
    "u6": None,
    "u7": None,
    "u8": "  ",
    "u9": "al.fox@acme\nx-inc.com",
    "u10": "al.fox@360.com",
}


@pytest.fixture
def contact_file(tmp_path):
    path = tmp_path / "contacts.csv"
    path.write_text(HEADER + ROWS, encoding="utf-8")
    return str(path)


def test_cells_and_addresses(spark, contact_file):
    contacts = with_address(read_contacts(spark, contact_file))
    rows = contacts.orderBy("row_pos").collect()
    assert [r.row_pos for r in rows] == list(range(10))
    assert {r.profile_url: r.address for r in rows} == WANT
    assert [r.profile_url for r in rows if not r.address_is_inferred] == ["u1", "u8"]
    assert all(r.error is None for r in rows)


def test_every_spelling_of_missing(spark, tmp_path):
    path = tmp_path / "na.csv"
    path.write_text(HEADER + "".join(f'u,"{t}",a,b,c\n' for t in S.NA_TOKENS) + "u,na,a,b,c\nu, ,a,b,c\n")
    got = [r.email for r in read_contacts(spark, str(path)).orderBy("row_pos").collect()]
    assert got == [None] * 19 + ["na", " "]


def test_a_bad_row_is_kept_with_its_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(HEADER + "u1,a@b,c,d,e\nu2,a@b,c,d,e,too,many\nu3,a@b,c,d,e\n")
    rows = read_contacts(spark, str(path)).orderBy("row_pos").collect()
    assert [(r.profile_url, r.error is None) for r in rows] == [("u1", True), ("u2", False), ("u3", True)]


def test_positions_over_files_and_blocks(spark, tmp_path):
    for f in range(3):
        lines = "".join(f"f{f}r{i},,,,{'x' * (i % 50)}\n" for i in range(4000 * f + 10))
        (tmp_path / f"c{f}.csv").write_text(HEADER + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = read_contacts(spark, str(tmp_path), multi_line=False)
        assert rows.rdd.getNumPartitions() > 1
        got = rows.select("profile_url", "row_pos", F.regexp_extract("file_name", r"c(\d)\.csv", 1).alias("f")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 10 + 4010 + 8010
    ahead = {"0": 0, "1": 10, "2": 10 + 4010}
    assert all(r.profile_url == f"f{r.f}r{r.row_pos - ahead[r.f]}" for r in got)
    whole = read_contacts(spark, str(tmp_path)).select("profile_url", "row_pos").collect()
    assert {tuple(r) for r in whole} == {(r.profile_url, r.row_pos) for r in got} and len(whole) == len(got)


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "u1,a@b,Al,Fox,X\n")
    (tmp_path / "b.csv").write_text('email,Email,"No,te",Email,Person Linkedin Url\nno,c@d,n,second,u2\nx,,,,u3,more\n')
    (tmp_path / "c d.csv").write_text("Person Linkedin Url\nu4\n")
    rows = read_contacts(spark, str(tmp_path)).orderBy("row_pos").collect()
    got = [(r.row_pos, r.profile_url, r.email, r.company, r.error is None) for r in rows]
    assert got == [
        (0, "u1", "a@b", "X", True),
        (1, "u2", "c@d", None, True),
        (2, "u3", None, None, False),
        (3, "u4", None, None, True),
    ]
    loose = read_contacts(spark, str(tmp_path), gapless=False).collect()
    assert len({r.row_pos for r in loose}) == 4 and {r.email for r in loose} == {"a@b", "c@d", None}
    (tmp_path / "e.csv").write_text("Email\nx@y\n")
    with pytest.raises(ValueError):
        read_contacts(spark, str(tmp_path))
    contacts, runs = load_each(spark, str(tmp_path), F.lit("2024-01-01").cast("timestamp_ntz"))
    assert [(r.profile_url, r.row_pos) for r in contacts.orderBy("profile_url").collect()] == [
        ("u1", 0), ("u2", 0), ("u3", 1), ("u4", 0)
    ]
    assert [r.status for r in runs.orderBy("file_name").collect()] == [S.RUNNING] * 3 + [S.ERROR]
    contacts, runs = load_each(spark, str(tmp_path / "e.csv"), F.lit("2024-01-01").cast("timestamp_ntz"))
    assert contacts is None and runs.count() == 1


def test_the_limit_holds_over_many_files(spark, tmp_path):
    for f in range(6):
        (tmp_path / f"c{f}.csv").write_text(HEADER + "".join(f"f{f}r{i},,,,\n" for i in range(5)))
    run = read_contacts(spark, str(tmp_path)).withColumn("run_id", F.lit("r"))
    for dense in (True, False):
        days = plan_days(run, 10, dense=dense).groupBy("send_day").count().orderBy("send_day").collect()
        assert [tuple(d) for d in days] == [(0, 10), (1, 10), (2, 10)]


def test_rejected_files(spark, tmp_path, contact_file):
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    other = tmp_path / "other.csv"
    other.write_text("Email,Company\na@b,c\n")
    contacts, run = load_or_reject(spark, str(other), "r1", ts)
    row = run.first()
    assert contacts is None and (row.status, row.error_message) == ("Error", "Missing required columns.")
    contacts, run = load_or_reject(spark, str(tmp_path / "nowhere.csv"), "r2", ts)
    row = run.first()
    assert contacts is None and row.status == "Error" and row.error_message
    contacts, run = load_or_reject(spark, contact_file, "r3", ts)
    row = run.first()
    assert contacts.count() == 10 and (row.status, row.error_message) == ("Running", None)
    assert row.ts == dt.datetime(2024, 1, 1) and row.file_name == contact_file
    with pytest.raises(ValueError):
        require_columns(read_raw(spark, str(other)))


def test_url_column_alone_is_enough(spark, tmp_path):
    path = tmp_path / "urls.csv"
    path.write_text("Person Linkedin Url,Extra\nu1,x\n")
    row = read_contacts(spark, str(path)).first()
    assert (row.profile_url, row.email, row.company) == ("u1", None, None)


def test_address_on_file_wins(spark, contact_file):
    on_file = spark.createDataFrame([("u1", "old@x.org"), ("u7", "known@y.org"), ("zz", "no")], "profile_url string, on_file string")
    rows = resolve_address(read_contacts(spark, contact_file), on_file).collect()
    got = {r.profile_url: (r.address, r.address_source) for r in rows}
    assert len(rows) == 10
    assert got["u1"] == ("old@x.org", "on_file") and got["u7"] == ("known@y.org", "on_file")
    assert got["u8"] == ("  ", "supplied") and got["u2"][1] == "inferred" and got["u6"] == (None, None)


def test_short_rows_blank_lines_and_byte_order_marks(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_bytes(("\ufeff" + HEADER.strip() + '\r\nu1\r\n\r\nu2,"a,b@c"\r\nu3,a@b,c,d,"e\r\nf"\r\nu4,"x,y",1,2,3,4\r\n' + f'u5,"{"long, " * 5000}""q"" x"\r\n').encode())
    rows = read_contacts(spark, str(path)).orderBy("row_pos").collect()
    got = [(r.profile_url, r.email, r.company, r.error is None) for r in rows]
    assert got.pop() == ("u5", "long, " * 5000 + '"q" x', None, True)
    assert got == [
        ("u1", None, None, True),
        ("u2", "a,b@c", None, True),
        ("u3", "a@b", "e\nf", True),
        ("u4", "x,y", "3", False),
    ]
    assert [r.row_pos for r in rows] == [0, 1, 2, 3, 4]


def test_positions_in_file_order_without_a_second_pass(spark, contact_file):
    contacts = read_contacts(spark, contact_file, gapless=False)
    assert [r.profile_url for r in contacts.orderBy("row_pos").collect()] == [f"u{i}" for i in range(1, 11)]
    assert "Aggregate" not in contacts._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        read_contacts(spark, contact_file, multi_line=False, gapless=False)
