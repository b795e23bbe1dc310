"""Safe fixes: trimming text, as a proposal and as a new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.functions.missing import quoted, strip
from dqloom.operators.counts import wide_to_long
from dqloom.operators.frequency import Field, column_name, fields_of

SAMPLES = 5


def _changed(field: Field) -> Column:
    return F.coalesce(field.value != strip(field.value), F.lit(False))


def remediation_proposal(df: DataFrame) -> DataFrame:
    """M1: text columns with padded cells and how many rows each would change."""
    fields = fields_of(df, kinds=["string"])
    long = wide_to_long(df, fields, {"affected_rows": lambda f: F.count_if(_changed(f))})
    return long.filter(F.col("affected_rows") > 0).select(
        column_name(fields).alias("column_name"), "affected_rows",
        F.lit("whitespace_normalization").alias("remediation_type"),
    )


def affected_rows(df: DataFrame) -> DataFrame:
    """M1: corrections in all, and distinct rows with at least one."""
    fields = fields_of(df, kinds=["string"])
    flags = [_changed(f) for f in fields]
    some = F.lit(False)
    total = F.lit(0)
    for flag in flags:
        some = some | flag
        total = total + flag.cast("int")
    return df.select(some.alias("some"), total.alias("total")).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_corrections"),
        F.count_if("some").alias("affected_rows"),
    )


def remediation_samples(df: DataFrame, column: str, k: int = SAMPLES) -> DataFrame:
    """M1: a few before/after pairs of one column."""
    c = quoted(column)
    return (
        df.filter(c != strip(c)).select(c.alias("before"), strip(c).alias("after"))
        .orderBy("before").limit(k)
    )


def apply_trimming(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """M2: the corrected table; every other value is untouched."""
    chosen = {f.name for f in fields_of(df, columns, ["string"])}
    return df.select(
        *[
            strip(quoted(n)).alias(n) if n in chosen else quoted(n).alias(n)
            for n in df.columns
        ]
    )


def reassessment(before: DataFrame, after: DataFrame) -> DataFrame:
    """M3: metric scores before and after, with the difference."""
    def side(scores: DataFrame, name: str) -> DataFrame:
        return scores.filter(F.col("status") == "available").select(
            "metric", F.col("score").alias(name)
        )

    joined = side(before, "before_score").join(side(after, "after_score"), "metric", "full")
    return joined.withColumn("delta", F.round(F.col("after_score") - F.col("before_score"), 2))
