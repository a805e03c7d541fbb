from collections import Counter

import pytest
from pyspark.sql import functions as F

from postbag.operators import skew


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows share one key, some have none, some find nothing."""
    key = (
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 11 == 0, None)
        .otherwise(F.col("id") % 500)
        .cast("long")
    )
    facts = spark.range(6000).select("id", key.alias("k"))
    dims = spark.range(0, 600, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).union(
        spark.createDataFrame([(7, 70), (None, -1)], "k long, v long")
    )
    return facts, dims


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "right", "left_anti"])
@pytest.mark.parametrize("hot_rows, one_in", [(50, 1), (50, 4), (10**9, 1), (1, 1)])
def test_same_as_a_plain_join(spark, sides, how, hot_rows, one_in):
    facts, dims = sides
    hot = skew.hot_keys(facts, ["k"], ["id"], hot_rows, one_in)
    got = skew.salted_join(facts, dims, ["k"], ["id"], how, hot)
    assert rows(got) == rows(facts.join(dims, "k", how))


def test_finds_the_hot_key_only(spark, sides):
    hot = skew.hot_keys(sides[0], ["k"], ["id"], 100, 1).collect()
    assert [r.k for r in hot] == [7] and hot[0]._slices >= 20


def test_hot_rows_are_spread(spark, sides):
    """No slice of the hot key is much larger than asked for."""
    facts, dims = sides
    hot = skew.hot_keys(facts, ["k"], ["id"], 100, 1)
    slices = facts.join(hot, "k").groupBy("k", skew._slice(["id"], F.col("_slices"))).count()
    assert slices.agg(F.max("count")).first()[0] < 200


def test_default_settings_leave_small_tables_alone(spark, sides):
    facts, dims = sides
    assert skew.hot_keys(facts, ["k"], ["id"]).count() == 0
    assert rows(skew.salted_join(facts, dims, ["k"], ["id"], "left")) == rows(facts.join(dims, "k", "left"))
    with pytest.raises(ValueError):
        skew.salted_join(facts, dims, ["k"], ["id"], "full")
