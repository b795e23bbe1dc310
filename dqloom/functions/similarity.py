"""Similarity of names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_ratio(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer text's length; 1 for two empty texts.

    The edit distance stands in for a matching-blocks ratio, which Spark doesn't have: both
    are 1 for equal and 0 for wholly different texts.
    """
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longer)


def split_name(name: Column) -> Column:
    """Ordered lower-case tokens of an identifier: camel case, acronyms, digits, separators."""
    spaced = F.regexp_replace(
        name,
        r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})",
        " ",
    )
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_f1(a: Column, b: Column) -> Column:
    """F1 overlap of two token arrays; 0 when either is empty or nothing is shared."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    precision = common / F.size(F.array_distinct(a))
    recall = common / F.size(F.array_distinct(b))
    return F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def text_similarity(a: Column, b: Column) -> Column:
    """60% token F1, 40% sequence ratio; 0 when either side has no token."""
    ta, tb = split_name(a), split_name(b)
    ratio = sequence_ratio(F.array_join(ta, " "), F.array_join(tb, " "))
    usable = (F.size(ta) > 0) & (F.size(tb) > 0)
    return F.when(usable, token_f1(ta, tb) * 0.6 + ratio * 0.4).otherwise(F.lit(0.0))
