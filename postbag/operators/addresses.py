"""Contact columns and the address a message goes to."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag import schema as S
from postbag.functions.text import infer_email
from postbag.operators.skew import places, salted_join


def select_contact_fields(raw: DataFrame, *keep: str) -> DataFrame:
    """Header names to ours; a header the file lacks becomes a NULL column."""
    have = set(raw.columns)
    fields = [
        (F.col(f"`{header}`") if header in have else F.lit(None).cast("string")).alias(name)
        for header, name in S.CONTACT_HEADERS.items()
    ]
    return raw.select(*keep, *fields)


def supplied_or_inferred() -> Column:
    """The address from the file unless missing; blank text counts as supplied."""
    return F.coalesce(F.col("email"), infer_email(F.col("first_name"), F.col("last_name"), F.col("company")))


def with_address(contacts: DataFrame) -> DataFrame:
    return contacts.withColumns(
        {"address": supplied_or_inferred(), "address_is_inferred": F.col("email").isNull()}
    )


def resolve_address(
    contacts: DataFrame,
    on_file: DataFrame,
    spread: Sequence[str] | None = None,
    hot: DataFrame | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """An address on file (``profile_url, on_file``) wins, then the supplied, then the inferred one.

    Of several addresses on file for a profile the last by ``order`` is taken, columns of ``on_file``, and of
    those that are equal in it the greatest; so each contact comes back once. Contacts of one profile are spread
    by ``spread``, their run and position unless given.
    """
    known = on_file.where(F.col("on_file").isNotNull()).groupBy("profile_url")
    one = known.agg(F.max_by("on_file", F.struct(*order, "on_file")).alias("on_file"))
    spread = places(contacts) if spread is None else spread
    joined = salted_join(contacts, one, ["profile_url"], spread, "left", hot)
    inferred = infer_email(F.col("first_name"), F.col("last_name"), F.col("company"))
    source = (
        F.when(F.col("on_file").isNotNull(), "on_file")
        .when(F.col("email").isNotNull(), "supplied")
        .when(inferred.isNotNull(), "inferred")
    )
    address = F.coalesce(F.col("on_file"), F.col("email"), inferred)
    return joined.withColumns({"address": address, "address_source": source}).drop("on_file")
