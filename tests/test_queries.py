import pytest

import __spark_entry__ as entry
from oracle import connect, differences


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def test_every_query_has_sql():
    # queries of the subpackage may have no SQL; they are held against brute force in its own tests
    own = {n for n in entry.queries() if not n.startswith("op") or not n[2:3].isdigit()} - {"pipeline"}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, sf, db, name):
    rows, diff = differences(spark, db, sf, entry.queries()[name], entry.oracle_sql()[name])
    assert not diff and rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "send_day" in df.columns
