"""Labels and casts read off a row's own columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.functions.text import strip

# Review keys that end the wait, and what each of them means.
REVIEW_KEYS = ("Enter", "Shift", "Backspace")
GO, SKIP, UNRECOGNIZED = "go", "skip", "unrecognized"


def int_or_default(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))


def as_text(c: Column) -> Column:
    return c.cast("string")


def label_channel(c: Column) -> Column:
    """How the composer says it would send; the first phrase found decides."""
    text = strip(c)
    return (
        F.when(F.contains(text, F.lit(S.INMAIL_PHRASE)), "InMail")
        .when(F.contains(text, F.lit(S.EMAIL_PHRASE)), "Email")
        .otherwise("unknown")
    )


def ends_review(key: Column) -> Column:
    """True for the keys that count as an answer; others are typing."""
    return key.isin(*REVIEW_KEYS)


def label_decision(key: Column) -> Column:
    """Meaning of a review key; NULL where no key came."""
    return (
        F.when(key == "Enter", GO)
        .when(key == "Backspace", SKIP)
        .when(key.isNotNull(), UNRECOGNIZED)
    )
