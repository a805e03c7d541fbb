"""Connected components by alternating large and small stars over written edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.workspace import Stages


def _toward_minimum(both: DataFrame, only: str) -> DataFrame:
    """Each neighbour named by ``only`` is tied to the smallest node around ``u``.

    The minimum combines before the shuffle, and the join back is one that adaptive execution splits
    where a node has very many neighbours.
    """
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(only)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str = "components", stages: Stages | None = None) -> DataFrame:
    """``node``, ``component``: the smallest node that links ``(a, b)`` reach from each linked node.

    Nodes without links don't appear. NULL ends and links of a node to itself are ignored; repeated
    links and both directions count once. Only counts come to the driver. Tables of a round are taken away
    after the next; the last one, which the result reads, stays in ``stages``.
    """
    stages = stages or Stages(edges.sparkSession)
    now = stages.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        label,
    )
    mark = _mark(now)
    while mark[0]:
        both = now.selectExpr("a u", "b v").unionAll(now.selectExpr("b u", "a v"))
        large = _toward_minimum(both, "v > u").selectExpr("v u", "m v").where("u <> v").distinct()
        large = stages.keep(large, label)
        small = _toward_minimum(large, "true")
        small = small.selectExpr("v a", "m b").unionAll(small.selectExpr("u a", "m b"))
        before, now = now, stages.keep(small.where("a <> b").distinct(), label)
        stages.drop(before, large)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.selectExpr("a node", "b component").unionAll(now.selectExpr("b node", "b component").distinct())
