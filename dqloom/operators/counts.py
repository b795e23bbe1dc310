"""Column counts, distinctness, constants, identifiers (one row per column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqloom.functions import names
from dqloom.functions.missing import is_blank, is_empty, strip
from dqloom.operators.frequency import (
    LONG_TEXT,
    Field,
    column_name,
    display_text,
    fields_of,
    spelled_out,
    value_frequencies,
)

TOP_VALUES = 10
# Columns with no more values than this are listed in full.
LISTED_VALUES = 25
LOW_CARDINALITY = 50
NEAR_CONSTANT = 0.98
COLUMNS_PER_PASS = 100


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def wide_to_long(
    df: DataFrame, fields: Sequence[Field], metrics: dict[str, callable]
) -> DataFrame:
    """Aggregate `metrics[name](field)` for every column and return one row per column.

    All columns of a chunk share one scan and one map-side aggregation; chunks keep
    the generated code of very wide tables inside the JVM's method limits.
    """
    out: DataFrame | None = None
    for at in range(0, len(fields), COLUMNS_PER_PASS):
        chunk = fields[at:at + COLUMNS_PER_PASS]
        aggregates = [
            make(f).alias(f"{name}_{f.pos}") for f in chunk for name, make in metrics.items()
        ]
        row = df.agg(*aggregates)
        args: list[Column] = []
        for f in chunk:
            args += [F.lit(f.pos)] + [F.col(f"{name}_{f.pos}") for name in metrics]
        part = row.select(F.stack(F.lit(len(chunk)), *args).alias("pos", *metrics))
        out = part if out is None else out.unionByName(part)
    return out


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row, null and non-null counts per column."""
    fields = fields_of(df, columns)
    long = wide_to_long(
        df, fields,
        {"row_count": lambda f: F.count(F.lit(1)), "non_null_count": lambda f: F.count(f.value)},
    )
    nulls = F.col("row_count") - F.col("non_null_count")
    return long.select(
        column_name(fields).alias("column_name"), "row_count", nulls.alias("null_count"),
        "non_null_count", percent(nulls, F.col("row_count")).alias("null_percentage"),
    )


def blank_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty and whitespace-only strings; T9: padded values. Text columns only."""
    fields = fields_of(df, columns, ["string"])
    long = wide_to_long(
        df, fields,
        {
            "row_count": lambda f: F.count(F.lit(1)),
            "empty_string_count": lambda f: F.count_if(is_empty(f.value)),
            "whitespace_only_count": lambda f: F.count_if(is_blank(f.value)),
            "padded_count": lambda f: F.count_if(
                (f.value != strip(f.value)) & (strip(f.value) != F.lit(""))
            ),
        },
    )
    return long.select(
        column_name(fields).alias("column_name"), "row_count",
        "empty_string_count",
        percent(F.col("empty_string_count"), F.col("row_count")).alias("empty_string_percentage"),
        "whitespace_only_count",
        percent(F.col("whitespace_only_count"), F.col("row_count")).alias(
            "whitespace_only_percentage"
        ),
        "padded_count",
    )


def distinct_summary(vft: DataFrame) -> DataFrame:
    """C3, C4, C6 over a frequency table, per column position."""
    top = F.max(F.struct(F.col("cnt"), F.col("d"), F.col("l"), F.col("s")))
    out = vft.groupBy("pos").agg(
        F.sum("cnt").alias("non_null_count"),
        F.count(F.lit(1)).alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("cnt") > 1, F.col("cnt"))), F.lit(0)).alias(
            "duplicate_count"
        ),
        top.alias("top"),
    )
    top_text = F.coalesce(
        F.col("top.s"), F.col("top.l").cast("string"), F.col("top.d").cast("string")
    )
    share = F.col("top.cnt") / F.col("non_null_count")
    distinct = F.col("distinct_count")
    return out.select(
        "pos", "non_null_count", "distinct_count",
        (distinct / F.col("non_null_count") * 100).alias("distinct_percentage"),
        "duplicate_count",
        (F.col("non_null_count") - distinct).alias("duplicate_excess_count"),
        (distinct <= 1).alias("constant"),
        ((distinct > 1) & (share >= NEAR_CONSTANT)).alias("near_constant"),
        share.alias("top_value_share"),
        F.col("top.cnt").alias("top_count"),
        top_text.alias("top_value"),
        F.coalesce(F.col("top.d"), F.col("top.l").cast("double")).alias("top_number"),
        F.when(distinct <= 1, top_text).alias("representative_value"),
    )


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Distinct count per column, exact unless the caller asks for a sketch."""
    fields = fields_of(df, columns)
    if approximate:
        long = wide_to_long(
            df, fields,
            {
                "non_null_count": lambda f: F.count(f.value),
                "distinct_count": lambda f: F.approx_count_distinct(f.value, 0.01),
            },
        )
        return long.select(
            column_name(fields).alias("column_name"), "non_null_count", "distinct_count",
            percent(F.col("distinct_count"), F.col("non_null_count")).alias(
                "distinct_percentage"
            ),
            F.lit(True).alias("approximate"),
        )
    summary = distinct_summary(value_frequencies(df, columns, digest_over=LONG_TEXT))
    return summary.select(
        column_name(fields_of(df)).alias("column_name"), "non_null_count", "distinct_count",
        "distinct_percentage",
    )


def duplicate_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """C4: rows in value groups larger than one, and the excess over one per value."""
    summary = distinct_summary(value_frequencies(df, columns, digest_over=LONG_TEXT))
    return summary.select(
        column_name(fields_of(df)).alias("column_name"), "duplicate_count",
        "duplicate_excess_count",
    )


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Constant and near-constant columns with the share of the top value."""
    summary = distinct_summary(value_frequencies(df, columns, digest_over=LONG_TEXT))
    shown = summary.select(
        column_name(fields_of(df)).alias("column_name"), "constant", "near_constant",
        F.round(F.col("top_value_share") * 100, 4).alias("top_value_share_percentage"),
        "representative_value",
    )
    return spelled_out(df, shown, "representative_value")


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES,
    max_distinct: int = LOW_CARDINALITY, vft: DataFrame | None = None,
) -> DataFrame:
    """The k most frequent values of categorical columns (no datetimes)."""
    fields = [f for f in fields_of(df, columns) if f.kind != "datetime"]
    alone = vft is None
    if vft is None:
        vft = value_frequencies(df, [f.name for f in fields], digest_over=LONG_TEXT)
    else:
        vft = vft.filter(F.col("pos").isin([f.pos for f in fields]))
    sizes = vft.groupBy("pos").agg(
        F.count(F.lit(1)).alias("category_count"), F.sum("cnt").alias("non_null_count")
    )
    sizes = sizes.filter(
        (F.col("category_count") <= max_distinct)
        & (F.col("category_count") < F.col("non_null_count"))
    )
    # One row per table column.
    kept = vft.join(F.broadcast(sizes), "pos").withColumn("value", display_text())
    rank = Window.partitionBy("pos").orderBy(F.col("cnt").desc(), F.col("value"))
    shown = (
        kept.withColumn("position", F.row_number().over(rank))
        .filter(F.col("position") <= k)
        .select(
            column_name(fields).alias("column_name"), "position", "value",
            F.col("cnt").alias("count"),
            percent(F.col("cnt"), F.col("non_null_count")).alias("percentage"),
            "category_count",
        )
    )
    return spelled_out(df, shown, "value") if alone else shown


def column_catalog(df: DataFrame, table: str = "") -> DataFrame:
    """Schema rows: table, position, column name, type, storage kind."""
    rows = [(table, f.pos, f.name, f.dtype.simpleString(), f.kind) for f in fields_of(df)]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, pos int, column_name string, data_type string, kind string"
    )


def name_signals(columns: DataFrame, name: str = "column_name") -> DataFrame:
    """Identifier words found in column names."""
    c = F.col(name)
    strong = names.matching_tokens(c, names.IDENTIFIER_STRONG_TOKENS)
    weak = names.matching_tokens(c, names.IDENTIFIER_WEAK_TOKENS)
    return (
        columns.withColumn("name_tokens", names.name_tokens(c))
        .withColumn("strong_matches", strong)
        .withColumn("weak_matches", weak)
        .withColumn("strong_name", F.size("strong_matches") > 0)
        .withColumn("weak_name", F.size("weak_matches") > 0)
        .withColumn("code_name", names.has_token(c, names.CODE_LIKE_TOKENS))
        .withColumn("date_name", names.has_token(c, names.COMPACT_DATE_TOKENS))
    )


def identifier_signals(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Unique over its non-null rows and named like an identifier."""
    fields = fields_of(df, columns)
    catalog = name_signals(column_catalog(df)).filter(F.col("pos").isin([f.pos for f in fields]))
    nulls = null_counts(df, columns)
    summary = distinct_summary(value_frequencies(df, columns, digest_over=LONG_TEXT))
    joined = catalog.join(nulls.drop("non_null_count"), "column_name").join(
        summary, "pos", "left"
    )
    non_null = F.coalesce(F.col("non_null_count"), F.lit(0))
    distinct = F.coalesce(F.col("distinct_count"), F.lit(0))
    return joined.select(
        "column_name",
        (F.col("strong_name") | F.col("weak_name")).alias("identifier_name_signal"),
        F.round(percent(non_null, F.col("row_count")), 4).alias(
            "identifier_completeness_percentage"
        ),
        F.round(percent(distinct, non_null), 4).alias("identifier_uniqueness_percentage"),
        ((non_null > 0) & (distinct == non_null) & F.col("strong_name")).alias(
            "identifier_signal"
        ),
    )
