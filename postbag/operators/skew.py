"""Many-to-one equi-joins that stay balanced when one key holds a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # rows of one key that one task may take
MAX_HOT_KEYS = 10_000  # bounds the broadcast; keys below that rank are no large share of anything
SAMPLE_ONE_IN = 64  # share of rows looked at to find hot keys; results never depend on it
NULL_SLICES = 1_024


def hot_keys(
    facts: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
    sample_one_in: int = SAMPLE_ONE_IN,
) -> DataFrame:
    """Keys with about ``hot_rows`` rows or more, and the number of slices each is to be cut into.

    The sample is taken by content, so that every evaluation of this plan, also after a lost
    executor, picks the same keys.
    """
    rows = facts.where(F.col(keys[0]).isNotNull())
    if sample_one_in > 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(17), *keys, *spread), F.lit(sample_one_in)) == 0)
    share = max(hot_rows / sample_one_in, 1.0)
    return hottest(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "_n", share)


def hottest(counts: DataFrame, keys: Sequence[str], n: str, share: float = HOT_ROWS) -> DataFrame:
    """As ``hot_keys``, from counts per key there are already."""
    return (
        counts.where(F.col(n) >= share)
        .orderBy(F.col(n).desc(), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*keys, (F.ceil(F.col(n) / F.lit(float(share))) + 1).cast("int").alias("_slices"))
    )


def places(contacts: DataFrame) -> list[str]:
    """What tells contacts of a key apart: their run, if they have one, and their position in it."""
    return [c for c in ("run_id", "row_pos") if c in contacts.columns]


def _slice(spread: Sequence[str], slices: Column) -> Column:
    return F.pmod(F.xxhash64(*spread), slices.cast("bigint")).cast("int")


def salted_join(
    facts: DataFrame,
    dims: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join rows to the one row of ``dims`` that shares their ``keys``.

    ``spread`` names columns of ``facts`` that differ between rows of one key. Rows of a hot key
    are cut into slices by them, and the key's single row in ``dims`` is copied once per slice; all
    other rows join as usual. ``how``: ``inner``, ``left`` and ``left_anti`` keep the side of
    ``facts``, ``right`` keeps every row of ``dims``. ``hot`` comes from ``hot_keys`` and is measured
    on ``facts`` if not given; give it where ``facts`` is itself the result of long work.
    """
    if how not in ("inner", "left", "left_anti", "right"):
        raise ValueError(f"unsupported join type: {how}")
    keys = list(keys)
    hot = F.broadcast(hot_keys(facts, keys, spread) if hot is None else hot)
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    sliced_facts = (
        facts.join(hot, keys, "left")
        .withColumn(
            "_slice",
            F.when(no_key, _slice(spread, F.lit(NULL_SLICES)))
            .when(F.col("_slices").isNotNull(), _slice(spread, F.col("_slices")))
            .otherwise(0),
        )
        .drop("_slices")
    )
    copies = dims.join(hot, keys, "left").withColumn(
        "_slice",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1)),
    )
    on = [*keys, "_slice"]
    if how == "right":
        # Of a hot key that has rows, copies without a match are not unmatched rows of dims. A caller's
        # list may hold keys without rows; those are taken off it.
        present = facts.select(*keys).join(hot, keys, "left_semi").distinct().withColumn("_present", F.lit(True))
        copies = copies.join(present, keys, "left")
        joined = sliced_facts.withColumn("_found", F.lit(True)).join(copies, on, "right")
        once = F.col("_present").isNull() & (F.col("_slice") == 0)
        joined = joined.where(F.col("_found").isNotNull() | F.col("_slices").isNull() | once).drop("_present")
        return joined.drop("_slice", "_slices", "_found")
    return sliced_facts.join(copies.drop("_slices"), on, how).drop("_slice")
