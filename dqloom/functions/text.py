"""Text patterns and shapes as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqloom.functions.dates import DATE_SHAPE
from dqloom.functions.missing import WHITESPACE_CLASS, strip

# Text patterns, anchored on both ends.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE_SHAPE = r"^\+?[0-9][0-9().\-" + WHITESPACE_CLASS + r"]{5,}$"
POSTAL = (
    r"^(?:\d{3,10}"
    r"|[A-Za-z]{1,2}\d[A-Za-z\d]?\s?\d[A-Za-z]{2}"
    r"|[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d"
    r"|\d{5}-\d{4}"
    r"|\d{4}\s?[A-Za-z]{2})$"
)
CURRENCY = r"^[A-Z]{3}$"
NUMERIC = r"^[-+]?\d+(?:\.\d+)?$"
ALPHANUMERIC = r"^[A-Za-z0-9]+$"
ANY_WHITESPACE = "[" + WHITESPACE_CLASS + "]"
SPECIAL = "[^A-Za-z0-9" + WHITESPACE_CLASS + "]"
PLAIN_RUN = "[A-Za-z0-9" + WHITESPACE_CLASS + "]++"

# Words that stand for "no value".
DISGUISED_MISSING = (
    "n/a", "na", "nan", "null", "none", "nil", "missing", "unknown",
    "undefined", "tbd", "not available", "not applicable", "-", "--", "?",
    "??", "..",
)

FREE_TEXT_MEAN_LENGTH = 64


def pattern_flags(value: Column) -> dict[str, Column]:
    """The nine structural pattern tests of one text value."""
    text = strip(value)
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    date = text.rlike(DATE_SHAPE)
    return {
        "email_like": text.rlike(EMAIL),
        "phone_like": text.rlike(PHONE_SHAPE) & digits.between(7, 15) & ~date,
        "postal_like": text.rlike(POSTAL),
        "currency_like": text.rlike(CURRENCY),
        "numeric_like": text.rlike(NUMERIC),
        "date_like": date,
        "alphanumeric_like": text.rlike(ALPHANUMERIC),
        "contains_whitespace": value.rlike(ANY_WHITESPACE),
        "contains_special_character": value.rlike(SPECIAL),
    }


def shape_of(value: Column) -> Column:
    """Letters to A, digits to 9, everything else kept."""
    return F.regexp_replace(F.regexp_replace(value, "[A-Za-z]", "A"), r"\p{Nd}", "9")


def cased_shape_of(value: Column) -> Column:
    """Upper-case letters to A, lower-case ones to a, digits to 9, everything else kept."""
    plain = F.translate(value, string.ascii_letters + string.digits, "a" * 26 + "A" * 26 + "9" * 10)
    return F.when(F.length(value) == F.octet_length(value), plain).otherwise(F.regexp_replace(plain, r"\p{Nd}", "9"))


def run_lengths(tokens: Column) -> Column:
    """array<string> -> array<struct<t, n>> of consecutive equal tokens."""
    empty = F.array().cast("array<struct<t:string,n:int>>")

    def step(acc: Column, token: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last["t"].alias("t"), (last["n"] + 1).alias("n"))),
        )
        fresh = F.concat(acc, F.array(F.struct(token.alias("t"), F.lit(1).alias("n"))))
        return F.when((F.size(acc) > 0) & (last["t"] == token), grown).otherwise(fresh)

    return F.aggregate(tokens, empty, step)


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def collapse_shape(shape: Column) -> Column:
    """AA-9999 -> A{2}-9{4}."""
    runs = run_lengths(characters(shape))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.when(r["n"] == 1, r["t"]).otherwise(
                F.concat(r["t"], F.lit("{"), r["n"].cast("string"), F.lit("}"))
            ),
        ),
        "",
    )
