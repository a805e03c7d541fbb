"""Compares queries with their SQL, value by value, in any row order.

Run as ``python tests/oracle.py [folder] [query ...]``.
"""

import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(row[i] for i in order) for row in rows)


def differences(spark, db, folder, query, sql):
    """``(rows, what differs)``, the latter empty when both results are equal."""
    df = query(spark, folder)
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    want_columns, want = _rows(columns, result.fetchall())
    if got_columns != want_columns:
        return got.total(), [f"columns {got_columns} and {want_columns}"]
    extra, lacking = got - want, want - got
    out = [f"only in Spark ({extra.total()}): {r}" for r in list(extra)[:3]]
    out += [f"only in SQL ({lacking.total()}): {r}" for r in list(lacking)[:3]]
    return got.total(), out


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", os.environ.get("SESSION_ZONE", "UTC"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    sql = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            n, diff = differences(session, database, folder, query, sql[name])
        except Exception as e:
            n, diff = -1, [f"{type(e).__name__}: {str(e)[:1500]}"]
        print(f"{'ok ' if not diff else 'BAD'} {name:20} {n:8} rows {time.time() - start:6.1f} s", flush=True)
        for d in diff:
            print("     ", d[:1500], flush=True)
        if diff:
            bad.append(name)
    print("failed:", bad)
