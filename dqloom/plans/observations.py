"""Findings with their evidence, read off a profile.

Inputs are schema-sized frames: one row per column, per key candidate, per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_COMPLETE = 90.0


def _finding(
    frame: DataFrame, rank: int, severity: str, code: str, when: Column, evidence: Column,
    column: Column | None = None,
) -> DataFrame:
    pos = F.col("pos") if "pos" in frame.columns else F.lit(-1)
    name = F.lit(None).cast("string") if column is None else column
    return frame.filter(when).select(
        pos.cast("int").alias("pos"), F.lit(rank).alias("rank"), F.lit(severity).alias("severity"),
        F.lit(code).alias("code"), name.alias("column_name"), F.to_json(evidence).alias("evidence"),
    )


def observations(
    columns: DataFrame, duplicates: DataFrame, completeness: DataFrame, composites: DataFrame,
    dependencies: DataFrame, limit: int | None = None,
) -> DataFrame:
    """severity, code, column and evidence of every finding in order; a display may ask for
    the first `limit`."""
    frames = table_findings(columns, duplicates, completeness, composites, dependencies)
    frames += column_findings(columns)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    order = Window.orderBy("pos", "rank", "column_name")
    numbered = out.withColumn("n", F.row_number().over(order))
    if limit is not None:
        numbered = numbered.filter(F.col("n") <= limit)
    return numbered.select("n", "severity", "code", "column_name", "evidence")


def table_findings(
    columns: DataFrame, duplicates: DataFrame, completeness: DataFrame, composites: DataFrame,
    dependencies: DataFrame,
) -> list[DataFrame]:
    broken = dependencies.agg(
        F.count_if(F.col("coverage_percentage") < 100).alias("pairs_with_violations")
    )
    facts = columns.agg(
        F.collect_list(F.when(F.col("datetime").isNotNull(), F.col("column_name"))).alias("dated"),
        F.collect_list(
            F.when(F.col("datetime").isNull() & F.col("top_values").isNotNull(),
                   F.col("column_name"))
        ).alias("categorical"),
        F.collect_list(F.when(F.col("free_text"), F.col("column_name"))).alias("free"),
        F.collect_list(F.when(F.col("float_measure"), F.col("column_name"))).alias("measures"),
    )
    members = F.col("columns")
    grain = (
        F.arrays_overlap(members, F.col("dated")) & F.arrays_overlap(members, F.col("categorical"))
        & ~F.arrays_overlap(members, F.col("measures"))
    )
    useful = ~F.arrays_overlap(members, F.col("free")) & (
        (F.size("key_like_members") > 0) | grain
    )
    best = (
        composites.join(F.broadcast(facts)).filter(useful)
        .orderBy(F.col("composite_uniqueness_percentage").desc(), F.size("columns"),
                 F.size("key_like_members").desc(), F.col("composite_distinct_count").desc(),
                 "distinct_product", F.array_join("columns", ","))
        .limit(1)
    )
    return [
        _finding(broken, 0, "warning", "dependency_violations",
                 F.col("pairs_with_violations") > 0, F.struct("pairs_with_violations")),
        _finding(best, 1, "info", "composite_uniqueness_candidate", F.lit(True),
                 F.struct("columns", "composite_uniqueness_percentage", "near_exact")),
        _finding(duplicates, 2, "warning", "duplicate_rows",
                 F.col("complete_duplicate_rows") > 0,
                 F.struct("complete_duplicate_rows", "complete_duplicate_excess_count")),
        _finding(completeness, 3, "warning", "row_completeness_low",
                 (F.col("row_count") > 0)
                 & (F.col("fully_complete_percentage") < ROWS_COMPLETE),
                 F.struct("fully_complete_percentage", "rows_with_any_null")),
    ]


def column_findings(columns: DataFrame) -> list[DataFrame]:
    c = F.col
    number, text, date = c("numeric"), c("text"), c("datetime")
    yes = F.lit(True)
    checked = number.isNotNull() | text.isNotNull()
    format_known = F.coalesce(date["detected_format"], F.lit("")) != ""

    def found(rank: int, severity: str, code: str, when: Column, *evidence: Column | str):
        return _finding(
            columns, rank, severity, code, F.coalesce(when, ~yes), F.struct(*evidence),
            c("column_name"),
        )

    return [
        found(10, "info", "date_format_detected", format_known,
              date["detected_format"].alias("detected_format"),
              date["parse_success_percentage"].alias("parse_success_percentage"),
              date["format_ambiguous"].alias("format_ambiguous")),
        found(11, "warning", "date_format_ambiguous", date["format_ambiguous"],
              date["detected_format"].alias("detected_format"),
              date["format_confidence_percentage"].alias("format_confidence_percentage")),
        found(12, "info", "constant_column", checked & c("constant"),
              c("representative_value").alias("value")),
        found(13, "warning", "near_constant_column", checked & c("near_constant"),
              "top_value_share_percentage"),
        found(14, "warning", "leading_zero_loss_suspected", c("leading_zero_loss_suspected"),
              number["leading_zero_loss_count"].alias("leading_zero_loss_count"),
              number["digit_length_distribution"].alias("digit_length_distribution")),
        found(15, "info", "code_like_numeric", c("code_like"),
              number["integer_valued"].alias("integer_valued")),
        found(16, "warning", "disguised_missing_values", text["disguised_missing_count"] > 0,
              text["disguised_missing_count"].alias("disguised_missing_count"),
              text["disguised_missing_values"].alias("disguised_missing_values")),
        found(17, "warning", "case_variants", text["case_variant_groups"] > 0,
              text["case_variant_groups"].alias("case_variant_groups")),
        found(18, "warning", "whitespace_padding", c("leading_trailing_whitespace_count") > 0,
              "leading_trailing_whitespace_count"),
        found(19, "info", "dense_integer_counter", number["counter_like"],
              number["dense"].alias("dense"), number["step_one"].alias("step_one")),
        found(20, "info", "identifier_repeats", c("identifier_repeats"),
              "distinct_percentage", "identifier_like_reasons"),
        found(21, "info", "regular_pattern", text["is_regular"] & ~format_known,
              text["dominant_shape"].alias("dominant_shape"),
              text["display_shape"].alias("dominant_display_shape"),
              text["dominant_coverage_percentage"].alias("dominant_coverage_percentage"),
              text["suggested_regex"].alias("suggested_regex")),
    ]
