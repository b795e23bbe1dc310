"""Evidence read from column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name tokens that mark codes and identifiers.
IDENTIFIER_STRONG_TOKENS = (
    "id", "identifier", "uuid", "guid", "key", "keys", "fk", "pk", "ref",
    "reference", "sku", "serial",
)
IDENTIFIER_WEAK_TOKENS = ("code", "number", "no")
CODE_TOKENS = (
    "zip", "zipcode", "postal", "postcode", "pin", "pincode", "phone",
    "mobile", "tel", "telephone", "fax", "id", "code", "sku", "serial",
    "account", "acct", "ssn", "ref", "reference",
)
CODE_LIKE_TOKENS = CODE_TOKENS + ("key", "keys", "fk", "pk")
COMPACT_DATE_TOKENS = (
    "date", "dt", "day", "time", "timestamp", "created", "updated", "dob",
    "birth",
)


def name_tokens(name: Column) -> Column:
    """Lower-case word tokens of snake, kebab and camel case names."""
    spaced = F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def literal_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def has_token(name: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(name_tokens(name), literal_array(words))


def matching_tokens(name: Column, words: tuple[str, ...]) -> Column:
    return F.filter(name_tokens(name), lambda t: t.isin(*words))
