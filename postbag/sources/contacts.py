"""Contact files."""

import csv
import io
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag import schema as S
from postbag import workspace
from postbag.operators.addresses import select_contact_fields
from postbag.sources.logs import run_row
from postbag.sources.records import split_records, text_lines

CORRUPT = "_corrupt_record"


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*S.NA_TOKENS), c)


def misfit(record: Column, width: int | Column) -> Column:
    """The record if it has more cells than the header; a short one just lacks its last cells."""
    unquoted = F.regexp_replace(record, r'"[^"]*"', "")
    return F.when(F.size(F.split(unquoted, ",")) > width, record)


def csv_options(multi_line: bool = True) -> dict[str, str]:
    return {
        "header": "true",
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
    }


def _headers(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """``file_name, _layout``: the header record of each file that has one.

    Read with a single column, a longer record counts as corrupt and so comes back as it stands in the
    file; ``_layout`` starts with ``n`` then, and with ``1`` where the header is one cell.
    """
    cells = T.StructType([T.StructField(c, T.StringType()) for c in ("_only", CORRUPT)])
    rows = spark.read.options(**{**csv_options(multi_line), "header": "false"}).schema(cells).csv(path)
    placed = rows.select(
        F.col("_metadata.file_path").alias("file_name"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_place"),
        F.coalesce(F.concat(F.lit("n"), CORRUPT), F.concat(F.lit("1"), "_only"), F.lit("1")).alias("_layout"),
    )
    return placed.groupBy("file_name").agg(F.min_by("_layout", "_place").alias("_layout"))


def _names(layout: str) -> list[str]:
    """The names of a header's cells; of equal ones the first keeps the name, later ones get a number.

    Names that differ in case only count as equal, but those we look for come first.
    """
    record = layout[1:].lstrip("\ufeff")
    cells = [record] if layout[0] == "1" else next(csv.reader(io.StringIO(record, newline="")))
    names: dict[int, str] = {}
    taken = {CORRUPT, "file_name", "row_pos", "_start", "_id", "_first", "_n", "_offset"}  # columns of our own
    for i in sorted(range(len(cells)), key=lambda i: (cells[i] not in S.CONTACT_HEADERS, i)):
        name, k = cells[i] or f"Unnamed: {i}", 0
        while name.lower() in taken:
            k += 1
            name = f"{cells[i]}.{k}"
        taken.add(name.lower())
        names[i] = name
    return [names[i] for i in range(len(cells))]


def _lacking(names: Sequence[str]) -> list[str]:
    return [c for c in S.REQUIRED_HEADERS if c not in names]


def _commas(record: Column) -> Column:
    return F.length(record) - F.length(F.replace(record, F.lit(","))) + 1


def _text(fields: int, *more: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in [*[f"_c{i}" for i in range(fields)], *more]])


def _scan(spark: SparkSession, path: str, multi_line: bool, headers: DataFrame) -> DataFrame:
    """All rows of all files in one reading: ``_cells``, the record where it does not fit, file and block.

    What is read has as many cells as the widest header; only that number comes to the driver. Beside a
    narrower header, a row of just that width is no misfit to Spark: its record is made from its cells.
    """
    width = headers.agg(F.max(_width(F.col("_layout"), F.col("_layout")))).first()[0] or 1
    rows = spark.read.options(**csv_options(multi_line)).schema(_text(width, CORRUPT)).csv(path)
    return rows.select(
        F.array(*[f"_c{i}" for i in range(width)]).alias("_cells"),
        CORRUPT,
        F.col("_metadata.file_path").alias("file_name"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def _placed(headers: DataFrame) -> DataFrame:
    """``file_name, _width, _at, _accepted``: where each contact field is in a file, and if it has the required ones."""
    width = headers.agg(F.max(_commas(F.col("_layout")))).first()[0] or 1
    record = F.regexp_replace(F.substring("_layout", 2, 1 << 30), "^\ufeff", "")
    names = F.when(F.substring("_layout", 1, 1) == "1", F.array(record)).otherwise(_cells(record, width))
    places = {f: F.nullif(F.array_position("_names", F.lit(h)), F.lit(0)) for h, f in S.CONTACT_HEADERS.items()}
    lacking = F.lit(False)
    for h in S.REQUIRED_HEADERS:
        lacking = lacking | F.col("_at").getField(S.CONTACT_HEADERS[h]).isNull()
    return (
        headers.select("file_name", names.alias("_names"), _width(record, F.col("_layout")).alias("_width"))
        .withColumn("_at", F.struct(*[p.cast("int").alias(f) for f, p in places.items()]))
        .select("file_name", "_width", "_at", (~lacking).alias("_accepted"))
    )


def _width(record: Column, layout: Column) -> Column:
    cells = F.size(F.split(F.regexp_replace(record, r'"[^"]*"', ""), ","))
    return F.when(F.substring(layout, 1, 1) == "1", 1).otherwise(cells)


def _contacts(rows: DataFrame, placed: DataFrame, record: str, *keep: str, error: Column | None = None) -> DataFrame:
    """Contact fields by each file's own header, ``error`` for rows that do not fit, and the columns ``keep``.

    Rows meet the header of their file in a join and find their cells by the places it gives, so all
    layouts are read in one go and neither headers nor names of files leave the cluster.
    """
    found = rows.join(placed.where("_accepted").select("file_name", "_width", "_at"), "file_name")
    cells = {f: na_to_null(F.try_element_at("_cells", F.col("_at").getField(f))) for f in S.CONTACT_HEADERS.values()}
    wide = F.when(_commas(F.col(record)) > F.col("_width"), misfit(F.col(record), F.col("_width")))
    wide = F.when((F.size("_cells") > F.col("_width")) & F.col(record).isNull(), F.array_join("_cells", ",", "")).otherwise(wide)
    return found.select(
        *keep,
        *[c.alias(f) for f, c in cells.items()],
        F.coalesce(*([] if error is None else [error]), wide).alias("error"),
    )


def read_raw(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns of header CSVs as text, by each file's own header; types are never inferred.

    Beside them stand ``_corrupt_record`` (rows with more cells than their header), ``file_name`` and
    ``_start``, the place of the block. A file without one of the required columns is an error. The
    different headers, not the files that have them, come to the driver: they make the columns.
    """
    headers = workspace.keep(_headers(spark, path, multi_line), "headers")
    layouts = {r._layout: _names(r._layout) for r in headers.select("_layout").distinct().orderBy("_layout").collect()}
    if not layouts or any(_lacking(names) for names in layouts.values()):
        raise ValueError(S.MISSING_COLUMNS)
    rows = _scan(spark, path, multi_line, headers).join(headers, "file_name")
    columns: dict[str, list[Column]] = {}
    wide = []
    for layout, names in layouts.items():
        here = F.col("_layout") == layout
        full = F.col(CORRUPT).isNull() & (F.size("_cells") > len(names))
        wide.append(F.when(here & full, F.array_join("_cells", ",", "")).when(here, misfit(F.col(CORRUPT), len(names))))
        for i, name in enumerate(names):
            columns.setdefault(name, []).append(F.when(here, F.get("_cells", F.lit(i))))
    return rows.select(
        *[F.coalesce(*c).alias(name) for name, c in columns.items()],
        F.coalesce(*wide).alias(CORRUPT),
        "file_name",
        "_start",
    )


def require_columns(df: DataFrame) -> DataFrame:
    """The table as it is, or ``ValueError`` before any row is read."""
    if _lacking(df.columns):
        raise ValueError(S.MISSING_COLUMNS)
    return df


def _with_row_pos(raw: DataFrame, per_file: bool = False) -> DataFrame:
    """Number the rows from 0, files by path and rows as they stand in them; or each file's from 0.

    A task reads a block of a file in order. The rows are written once, with an id each, so that the
    first id of a block and the rows before it, one short row per block, come from the same reading.
    """
    rows = workspace.keep(raw.withColumn("_id", F.monotonically_increasing_id()), "contact-rows")
    blocks = rows.groupBy("file_name", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("file_name").orderBy("_start") if per_file else Window.orderBy("file_name", "_start")
    before = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.withColumn("_offset", F.coalesce(before, F.lit(0))).drop("_n")
    row_pos = F.col("_id") - F.col("_first") + F.col("_offset")
    return (
        rows.join(offsets, ["file_name", "_start"])
        .withColumn("row_pos", row_pos)
        .drop("_start", "_id", "_first", "_offset")
    )


def clean_contacts(raw: DataFrame, *keep: str) -> DataFrame:
    """Contact fields under our names, missing values as NULL, and ``error`` for rows that do not fit."""
    contacts = select_contact_fields(raw, *keep, CORRUPT)
    cleaned = {name: na_to_null(F.col(name)) for name in S.CONTACT_HEADERS.values()}
    return contacts.withColumns({**cleaned, "error": F.col(CORRUPT)}).drop(CORRUPT)


def _cells(record: Column, width: int) -> Column:
    """The cells of a record, as many as it has up to ``width``; the others are NULL."""
    fields = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(record, fields, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return F.array(*[parsed.getField(f"c{i}") for i in range(width)])


def _judged_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contacts of ``split_records``, numbered from 0 in each file, and ``file_name, _accepted`` for each file."""
    records = workspace.keep(records, "contact-records")
    first = records.where("_rec = 0 AND _unclosed IS NULL")
    headers = first.select("file_name", F.concat(F.lit("n"), "_record").alias("_layout"))
    placed = workspace.keep(_placed(headers), "headers")
    width = headers.agg(F.max(_commas(F.col("_layout")))).first()[0] or 1
    rows = records.where("_rec > 0 OR _unclosed IS NOT NULL").withColumn("_cells", _cells(F.col("_record"), width))
    rows = rows.withColumn("row_pos", F.col("_rec") - 1)
    return _contacts(rows, placed, "_record", "file_name", "row_pos", error=F.col("_unclosed")), placed


def read_split_contacts(spark: SparkSession, path: str) -> DataFrame:
    """``read_contacts`` with files read by many tasks each, whatever breaks are in quoted cells.

    Cells, positions and errors are those of ``read_contacts``, for files in which quotes only stand around
    cells or doubled inside them; see ``split_records`` for a quote that is never closed.
    """
    contacts, files = _judged_records(split_records(text_lines(spark, path)))
    if files.where("NOT _accepted").limit(1).count() or not files.limit(1).count():
        raise ValueError(S.MISSING_COLUMNS)
    contacts = workspace.keep(contacts, "split-contacts")
    sizes = contacts.groupBy("file_name").agg((F.max("row_pos") + 1).alias("_n"))
    before = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)  # one short row a file
    offsets = sizes.select("file_name", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return contacts.join(offsets, "file_name").withColumn("row_pos", F.col("row_pos") + F.col("_offset")).drop("_offset")


def load_lines(lines: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """Every file of ``text_lines`` as a run of its own: the contacts of those accepted, and a row of the run log each.

    ``run_id`` is the digest of the file's path, and ``row_pos`` starts at 0 in each file. Files that are
    wholly empty have no header to judge and no row.
    """
    contacts, files = _judged_records(split_records(lines))
    return contacts.withColumn("run_id", _run_of_file()), _run_rows(files, ts)


def _run_of_file() -> Column:
    return F.sha2("file_name", 256)


def _run_rows(files: DataFrame, ts: Column) -> DataFrame:
    """A row of the run log for each file: Running if it was accepted, or Error with the reason."""
    cells = {
        "run_id": _run_of_file(),
        "seq": F.lit(0),
        "ts": ts,
        "file_name": F.col("file_name"),
        "status": F.when(F.col("_accepted"), S.RUNNING).otherwise(S.ERROR),
        "error_message": F.when(~F.col("_accepted"), S.MISSING_COLUMNS),
    }
    return files.select(*[cells[f.name].cast(f.dataType).alias(f.name) for f in S.RUNS_LOG.fields])


def read_contacts(
    spark: SparkSession, path: str, multi_line: bool = True, gapless: bool = True
) -> DataFrame:
    """``file_name, row_pos``, the contact fields, and ``error`` for rows that could not be parsed.

    Cells are found by each file's own header. ``row_pos`` counts over all files, which go by path, so
    that it names one row of the run. Quoted cells may span lines, for which a file must be read by one
    task; a break inside a cell comes back as a line feed. ``multi_line=False`` lets Spark split files
    that have no such cells. With ``gapless=False`` positions are unique and in file order but have
    gaps, which spares writing the rows.
    """
    if not gapless and not multi_line:
        raise ValueError("rows of a split file can only be numbered without gaps")
    headers = workspace.keep(_headers(spark, path, multi_line), "headers")
    placed = workspace.keep(_placed(headers), "headers")
    if placed.where("NOT _accepted").limit(1).count() or not placed.limit(1).count():
        raise ValueError(S.MISSING_COLUMNS)
    raw = _scan(spark, path, multi_line, headers)
    rows = _with_row_pos(raw) if gapless else raw.withColumn("row_pos", F.monotonically_increasing_id())
    return _contacts(rows, placed, CORRUPT, "file_name", "row_pos")


def load_or_reject(
    spark: SparkSession, path: str, run_id: str, ts: Column, multi_line: bool = True
) -> tuple[DataFrame | None, DataFrame]:
    """The contacts, or ``None``, and the row for the run log: Running, or Error with the reason."""
    try:
        contacts = read_contacts(spark, path, multi_line)
    except (AnalysisException, ValueError) as e:
        return None, run_row(spark, run_id, path, S.ERROR, str(e), ts)
    return contacts, run_row(spark, run_id, path, S.RUNNING, None, ts)


def load_each(
    spark: SparkSession, path: str, ts: Column, multi_line: bool = True
) -> tuple[DataFrame | None, DataFrame]:
    """Every file as a run of its own: the contacts of those accepted, and a row of the run log for each file.

    ``run_id`` is the digest of the file's path, and ``row_pos`` starts at 0 in each file. Files that are
    wholly empty have no header to judge and no row.
    """
    headers = workspace.keep(_headers(spark, path, multi_line), "headers")
    placed = workspace.keep(_placed(headers), "headers")
    runs = _run_rows(placed, ts)
    if not placed.where("_accepted").limit(1).count():
        return None, runs
    rows = _with_row_pos(_scan(spark, path, multi_line, headers), per_file=True)
    return _contacts(rows, placed, CORRUPT, "file_name", "row_pos").withColumn("run_id", _run_of_file()), runs
