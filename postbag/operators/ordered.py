"""Order-dependent values over runs of any size.

A window over one run is one task, however large the run. Here a run is cut by position into
leaves, leaves into branches, and only short lists of totals are ever ordered as a whole: with the
default shifts a leaf has at most 2**18 positions, a branch 2**22 leaves, a run 2**23 branches.
Where positions do not repeat, no task sorts more than that, whatever the skew.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag import workspace

SHIFTS = (18, 40)


_BLANKS = {"string": "", "boolean": "false", "date": "1970-01-01"}


def _run_keys(df: DataFrame, run: Sequence[str]) -> dict[str, Column]:
    """Columns without NULLs that are equal just where the run columns are, NULL being one value.

    Plain columns sort and hash faster than a struct of them, which is left for other types.
    """
    kinds = dict(df.dtypes)
    keys = {}
    for i, name in enumerate(run):
        kind = kinds[name]
        if "<" in kind or kind in ("binary", "variant"):
            keys[f"_r{i}"] = F.struct(name)
            continue
        blank = _BLANKS.get(kind, "1970-01-01" if kind.startswith("timestamp") else "0")
        keys[f"_r{i}"] = F.coalesce(F.col(name), F.lit(blank).cast(kind))
        keys[f"_n{i}"] = F.col(name).isNull()
    return keys


def _carry(
    df: DataFrame,
    run: Sequence[str],
    position: Column,
    value: Column,
    out: str,
    total: Callable[[Column], Column],
    merge: Callable[..., Column],
    backward: bool,
    shifts: Sequence[int],
) -> DataFrame:
    """``total`` of ``value`` over the rows before (or after) each row's position in its run.

    A NULL run is a run like any other; a row without a position gets NULL.
    """
    keys = _run_keys(df, run)
    rows = df.withColumns({**keys, "_pos": position, "_val": value})
    placed = F.shiftright("_pos", shifts[0])
    # Rows without a position are before and after nothing; they are spread over leaves no
    # position can fall into, since there may be many of them.
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    astray = F.pmod(F.xxhash64(*hashed), F.lit(1_024)) - F.lit(1 << 62)

    def direction(c: str) -> Column:
        return -F.col(c) if backward else F.col(c)

    # Level 0 looks at rows, level i at totals of level i - 1.
    level = (
        rows.where(F.col("_pos").isNotNull())
        .groupBy(*keys, placed.alias("_k0"))
        .agg(total(F.col("_val")).alias("_t"))
    )
    carried = None
    for i, shift in enumerate(shifts):
        key, above = f"_k{i}", f"_k{i + 1}"
        groups = list(keys)
        last = i + 1 == len(shifts)
        if not last:
            level = level.withColumn(above, F.shiftright(key, shifts[i + 1] - shift))
            groups.append(above)
        w = (
            Window.partitionBy(*groups)
            .orderBy(direction(key))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        sums = level.withColumn(f"_c{i}", total(F.col("_t")).over(w)).drop("_t")
        carried = sums if carried is None else carried.join(sums, [*keys, key])
        if not last:
            level = level.groupBy(*groups).agg(total(F.col("_t")).alias("_t"))
    parts = [F.col(f"_c{i}") for i in range(len(shifts))]
    whole = merge(*parts) if len(parts) > 1 else parts[0]
    carried = carried.select(*keys, F.col("_k0").alias("_leaf"), whole.alias("_carried"))
    here = (
        Window.partitionBy(*keys, "_leaf")
        .orderBy(direction("_pos"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    found = F.when(F.col("_pos").isNotNull(), merge(F.col("_here"), F.col("_carried")))
    return (
        rows.withColumn("_leaf", F.coalesce(placed, astray))
        .withColumn("_here", total(F.col("_val")).over(here))
        .join(carried, [*keys, "_leaf"], "left")
        .withColumn(out, found)
        .drop(*keys, "_leaf", "_pos", "_val", "_here", "_carried")
    )


def sum_before(
    df: DataFrame,
    run: Sequence[str],
    position: str,
    value: Column,
    out: str,
    shifts: Sequence[int] = SHIFTS,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same run; 0 for the first."""

    def merge(*parts: Column) -> Column:
        added = F.lit(0).cast("bigint")
        for p in parts:
            added = added + F.coalesce(p, F.lit(0).cast("bigint"))
        return added

    return _carry(
        df, run, F.col(position), value.cast("bigint"), out, F.sum, merge, False, shifts
    )


def least_after(
    df: DataFrame,
    run: Sequence[str],
    position: Column,
    value: Column,
    out: str,
    shifts: Sequence[int] = SHIFTS,
) -> DataFrame:
    """Least ``value`` over the rows of the same run at a later position; NULL if there is none."""
    return _carry(df, run, position, value, out, F.min, F.least, True, shifts)


def row_position(
    df: DataFrame, run: Sequence[str], order: str, out: str = "row_pos", shifts: Sequence[int] = SHIFTS
) -> DataFrame:
    """Gapless 0-based position of each row in its run by an integer column without repeats."""
    return sum_before(df, run, order, F.lit(1), out, shifts)


_ID_BITS = 33  # of a monotonically increasing id, those that count inside a task


def ranged_sum(df: DataFrame, order: Sequence[Column], value: Column | None, out: str) -> tuple[DataFrame, DataFrame]:
    """Sum of ``value`` (1 each if not given) over all rows before each row, in one order of the whole table.

    Gives the rows with ``_part`` and ``out``, and ``_part, _first``: the sum before each part. Parts are
    ranges of the order, cut by Spark so that they have like numbers of rows. Rows that are equal in
    ``order`` are told apart by a digest of all they hold, so neither a large group nor one value that most
    rows share ends in one task. The rows are written once, with their places, since ranges come from a
    sample; only one total a part is ever ordered as a whole.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    keys = [*order, F.xxhash64(*hashed)]
    rows = df.withColumn("_val", F.lit(1).cast("bigint") if value is None else F.coalesce(value.cast("bigint"), F.lit(0)))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    rows = workspace.keep(rows.withColumn("_part", F.shiftright("_id", _ID_BITS)), "ordered")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.sum("_val").alias("_total"))
    first = F.coalesce(F.sum("_total").over(before.orderBy("_part")), F.lit(0).cast("bigint"))
    parts = totals.select("_part", first.alias("_first"))
    if value is None:
        here = F.col("_id").bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    else:
        here = F.coalesce(F.sum("_val").over(before.partitionBy("_part").orderBy("_id")), F.lit(0).cast("bigint"))
    summed = rows.withColumn("_here", here).join(parts, "_part")
    return summed.withColumn(out, F.col("_first") + F.col("_here")).drop("_val", "_id", "_here", "_first"), parts


def marks_reached(rows: DataFrame, parts: DataFrame, value: str, marks: DataFrame, mark: str, out: str) -> DataFrame:
    """How many of the ``marks`` are not above each row's ``value``; rows and parts are from ``ranged_sum``.

    Parts and marks are merged by rank first, which says how many marks lie before each part and which part
    each mark lies in. Inside a part, rows and marks are merged by rank again. No pairs are formed.
    """
    small = parts.select(F.col("_first").alias("_at"), F.lit(1).alias("_kind"), "_part").unionByName(
        marks.select(F.col(mark).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("_part"))
    )
    so_far = Window.orderBy("_at", "_kind", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = small.withColumns(
        {"_lower": F.sum(1 - F.col("_kind")).over(so_far), "_into": F.last("_part", ignorenulls=True).over(so_far)}
    )
    base = merged.where("_kind = 1").select("_part", "_lower")
    inside = merged.where("_kind = 0 AND _into IS NOT NULL").select(F.col("_into").alias("_part"), F.col("_at").alias(value))
    both = rows.withColumn("_kind", F.lit(1)).unionByName(inside.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("_part").orderBy(value, "_kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("_met", F.sum(1 - F.col("_kind")).over(w)).where("_kind = 1")
    return counted.join(base, "_part").withColumn(out, F.col("_lower") + F.col("_met")).drop("_kind", "_met", "_lower")


def slice_rows(df: DataFrame, start: int, count: int, position: str = "row_pos") -> DataFrame:
    """Rows ``start`` to ``start + count - 1`` of every run."""
    return df.where((F.col(position) >= start) & (F.col(position) < start + count))
