"""The driver's tables, and pieces of SQL that several queries share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.functions.labels import as_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Blank characters inside an RE2 class, whose \s knows only ASCII.
BLANK = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def sql_strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def sql_slug(expr: str) -> str:
    return rf"replace(lower(regexp_replace({expr}, '[^\pL\pN_{BLANK}-]', '', 'g')), ' ', '-')"


def sql_micros(expr: str) -> str:
    return f"epoch_us({expr})"


def event_key() -> Column:
    """Events as review keys: three kinds answer, the others are typing."""
    return (
        F.when(F.col("event_type") == "click", "Enter")
        .when(F.col("event_type") == "purchase", "Shift")
        .when(F.col("event_type") == "error", "Backspace")
        .otherwise("a")
    )


SQL_EVENT_KEY = (
    "CASE event_type WHEN 'click' THEN 'Enter' WHEN 'purchase' THEN 'Shift' "
    "WHEN 'error' THEN 'Backspace' ELSE 'a' END"
)

SQL_DECISION = (
    "CASE WHEN pressed = 'Enter' THEN 'go' WHEN pressed = 'Backspace' THEN 'skip' "
    "WHEN pressed IS NOT NULL THEN 'unrecognized' END"
)


def event_number() -> Column:
    """The number an event carries in its JSON, 0 to 99."""
    return F.get_json_object("props", "$.k").try_cast("int")


SQL_EVENT_NUMBER = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"


def setting_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as one write of a setting named after its type, never zero."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("key"),
        as_text(event_number() + 1).alias("value"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def sql_setting(key: str, default: int) -> str:
    last = (
        f"SELECT TRY_CAST({SQL_EVENT_NUMBER} + 1 AS INTEGER) FROM events "
        f"WHERE event_type = '{key}' ORDER BY ts DESC, event_id DESC LIMIT 1"
    )
    return f"coalesce(({last}), {default})"
