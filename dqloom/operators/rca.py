"""Where failures concentrate. Observed shares only, no claim of cause."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqloom.functions.missing import null_if_nan, quoted, strip, value_text
from dqloom.operators.rules import Context

TOP_PATTERNS = 5
TOP_REPEATS = 3
MIN_REPEAT = 2
MAX_CATEGORIES = 50


def rule_columns(rule: Mapping[str, Any]) -> list[str]:
    params = dict(rule.get("parameters") or {})
    names = [rule.get("column"), *(rule.get("columns") or []), params.get("child_column")]
    return list(dict.fromkeys(n for n in names if n))


def _cells(failing: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ci, column, raw): one row per failing row and column."""
    args: list[Column] = []
    for i, name in enumerate(columns):
        dtype = failing.schema[name].dataType
        args += [F.lit(i), F.lit(name), value_text(null_if_nan(quoted(name), dtype), dtype)]
    return failing.select(F.stack(F.lit(len(columns)), *args).alias("ci", "column_name", "raw"))


def _share(total: Column) -> Column:
    return F.round(F.col("count") / total * 100, 1)


def low_cardinality_columns(
    df: DataFrame, exclude: Sequence[str], limit: int = MAX_CATEGORIES
) -> list[str]:
    """Text columns with at most `limit` distinct values.

    A sketch rules out the wide ones in one scan; only columns near the limit are
    then counted exactly.
    """
    texts = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]
    if not texts:
        return []
    row = df.agg(
        *[F.approx_count_distinct(quoted(c), 0.01).alias(f"d{i}") for i, c in enumerate(texts)]
    ).first()
    near = [c for i, c in enumerate(texts) if row[f"d{i}"] <= 2 * limit]
    if not near:
        return []
    sizes = (
        _cells(df, near).filter(F.col("raw").isNotNull())
        .groupBy("column_name", "raw").agg(F.lit(1).alias("one"))
        .groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    few = {r["column_name"] for r in sizes if r["n"] <= limit}
    return [c for c in near if c in few]


def concentration(
    failing: DataFrame, columns: Sequence[str], k: int = TOP_PATTERNS
) -> DataFrame:
    """A1: the k most frequent values of other columns among failing rows."""
    total = failing.agg(F.count(F.lit(1)).alias("total"))
    counted = (
        _cells(failing, columns).withColumn("value", strip(F.col("raw")))
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    sizes = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("values"))
    rank = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value"))
    # `sizes` has one row per column, `total` is one row.
    return (
        counted.join(F.broadcast(sizes.filter("values > 1")), "column_name")
        .withColumn("position", F.row_number().over(rank))
        .filter(F.col("position") <= k)
        .join(F.broadcast(total))
        .select("column_name", "position", "value", "count", _share(F.col("total")).alias(
            "percentage"))
    )


def whitespace_patterns(failing: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A2: failing values by text quality: padded, empty, other."""
    total = failing.agg(F.count(F.lit(1)).alias("total"))
    raw = F.col("raw")
    kind = (
        F.when(raw == "", "empty_string")
        .when(raw != strip(raw), "leading_or_trailing_whitespace")
        .otherwise("other")
    )
    return (
        _cells(failing, columns).filter(raw.isNotNull())
        .groupBy("column_name", kind.alias("value")).agg(F.count(F.lit(1)).alias("count"))
        .join(F.broadcast(total))
        .select("column_name", "value", "count", _share(F.col("total")).alias("percentage"))
    )


def repeated_values(failing: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A3: failing values that repeat: three per rule column, five overall."""
    total = failing.agg(F.count(F.lit(1)).alias("total"))
    counted = (
        _cells(failing, columns)
        .withColumn("value", F.coalesce(strip(F.col("raw")), F.lit("(missing)")))
        .groupBy("ci", "column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    rank = Window.partitionBy("ci").orderBy(F.col("count").desc(), F.col("value"))
    top = counted.withColumn("r", F.row_number().over(rank)).filter(
        (F.col("r") <= TOP_REPEATS) & (F.col("count") >= MIN_REPEAT)
    )
    return (
        top.orderBy(F.col("count").desc(), "ci", "r").limit(TOP_PATTERNS)
        .join(F.broadcast(total))
        .select("column_name", "value", "count", _share(F.col("total")).alias("percentage"))
    )


def analyze_failures(
    rules: Sequence[Mapping[str, Any]], ctx: Context,
    reported_columns: int | None = None,
) -> DataFrame:
    """A4: all three views for every given rule, as one long frame."""
    from dqloom.plans.quality import failing_rows

    out: DataFrame | None = None
    for rule in rules:
        df = ctx.tables[rule["table"]]
        own = [c for c in rule_columns(rule) if c in df.columns]
        failing = failing_rows(df, rule, ctx)
        views = {}
        if own:
            views["pattern"] = whitespace_patterns(failing, own)
            views["repeated"] = repeated_values(failing, own)
        other = low_cardinality_columns(df, own)[:reported_columns]
        if other:
            views["concentration"] = concentration(failing, other).drop("position")
        for view, frame in views.items():
            part = frame.select(
                F.lit(str(rule["rule_id"])).alias("rule_id"), F.lit(view).alias("view"),
                "column_name", "value", "count", "percentage",
            )
            out = part if out is None else out.unionByName(part)
    return out
