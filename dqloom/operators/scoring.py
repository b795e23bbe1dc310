"""Scores from rule results. N/A is never 0, an error is never a pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The quality dimensions in reporting order.
METRICS = (
    "completeness", "uniqueness", "validity", "accuracy", "consistency",
    "referential_integrity", "timeliness",
)
CRITICAL = 90.0


def latest_executions(executions: DataFrame) -> DataFrame:
    """The newest execution per rule.

    max_by folds in the map tasks, so a rule with many runs is not gathered.
    """
    rest = [c for c in executions.columns if c not in ("rule_id",)]
    newest = executions.groupBy("rule_id").agg(
        F.max_by(F.struct(*rest), F.col("execution_id")).alias("e")
    )
    return newest.select("rule_id", "e.*")


def _score(applicable: Column, failed: Column) -> Column:
    return F.round((applicable - failed) / applicable * 100, 2)


def metric_scores(results: DataFrame) -> DataFrame:
    """G1: one row per metric: score, counts, status."""
    ok = F.col("status") != "error"
    out = results.groupBy("metric").agg(
        F.coalesce(F.sum(F.when(ok, F.col("applicable_rows"))), F.lit(0)).alias(
            "applicable_records"
        ),
        F.coalesce(F.sum(F.when(ok, F.col("failed_rows"))), F.lit(0)).alias("failed_records"),
        F.count(F.lit(1)).alias("rule_count"),
        F.count_if(~ok).alias("error_count"),
    )
    status = (
        F.when(F.col("rule_count") == F.col("error_count"), "execution_error")
        .when(F.col("applicable_records") == 0, "not_applicable")
        .otherwise("available")
    )
    out = out.withColumn("status", status)
    score = F.when(
        F.col("status") == "available", _score(F.col("applicable_records"), F.col("failed_records"))
    ).otherwise(F.lit(0.0))
    return out.withColumn("score", score)


def weight_column(weights: Mapping[str, float] | None) -> Column:
    """Weight per metric; 1 where none is given."""
    w = F.lit(1.0)
    for metric, value in (weights or {}).items():
        w = F.when(F.col("metric") == metric, F.lit(float(value))).otherwise(w)
    return w


def dq_score(
    metrics: DataFrame, weighted: bool = False, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """One row: overall score over available metrics and what it leaves out."""
    w = weight_column(weights if weighted else None)
    ok = F.col("status") == "available"
    total_weight = F.sum(F.when(ok, w))
    overall = F.coalesce(
        F.when(total_weight > 0, F.sum(F.when(ok, F.col("score") * w)) / total_weight), F.lit(0.0)
    )
    return metrics.agg(
        F.round(overall, 2).alias("overall_score"),
        F.count_if(ok).alias("metric_count"),
        F.count_if(F.col("status") == "not_applicable").alias("excluded_metrics"),
        F.coalesce(F.sum("error_count"), F.lit(0)).alias("execution_errors"),
        F.count_if(ok & (F.col("score") < CRITICAL)).alias("critical_failures"),
    )


def critical_failures(metrics: DataFrame) -> DataFrame:
    """Metrics that the overall score must not hide."""
    return metrics.filter((F.col("status") == "available") & (F.col("score") < CRITICAL)).select(
        "metric", "score", "failed_records", "applicable_records"
    )


def _status(applicable: Column, error: Column) -> Column:
    return F.when(applicable > 0, "ok").when(error, "EXECUTION_ERROR").otherwise("N/A")


def score_breakdown(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Metric status and score per column, table and dataset.

    `rules` are the approved rules, `results` their latest executions; a rule
    without a result was not executed and counts as an error.
    """
    ran = results.select("rule_id", F.col("status").alias("run"), "applicable_rows", "failed_rows")
    joined = rules.join(ran, "rule_id", "left")
    good = F.col("run").isNotNull() & (F.col("run") != "error")
    per_column = joined.groupBy("table_name", "column_name", "metric").agg(
        F.coalesce(F.sum(F.when(good, F.col("applicable_rows"))), F.lit(0)).alias("applicable"),
        F.coalesce(F.sum(F.when(good, F.col("failed_rows"))), F.lit(0)).alias("failed"),
        F.bool_or(~good).alias("error"),
    ).withColumn("error", F.col("error") & (F.col("applicable") == 0))
    levels = per_column.groupingSets(
        [["table_name", "column_name", "metric"], ["table_name", "metric"], ["metric"]],
        "table_name", "column_name", "metric",
    ).agg(
        F.sum("applicable").alias("applicable"), F.sum("failed").alias("failed"),
        F.bool_or("error").alias("error"),
        F.grouping_id("table_name", "column_name", "metric").alias("gid"),
    )
    level = F.when(F.col("gid") == 0, "column").when(F.col("gid") == 2, "table").otherwise(
        "dataset"
    )
    measured = levels.select(
        level.alias("level"),
        F.coalesce("table_name", F.lit("")).alias("table_name"),
        F.coalesce("column_name", F.lit("")).alias("column_name"),
        "metric", "applicable", "failed", "error",
    )
    places = measured.select("level", "table_name", "column_name").distinct()
    grid = places.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in METRICS])))
    full = grid.join(measured, ["level", "table_name", "column_name", "metric"], "left")
    applicable = F.coalesce(F.col("applicable"), F.lit(0))
    return full.select(
        "level", "table_name", "column_name", "metric",
        _status(applicable, F.coalesce(F.col("error"), F.lit(False))).alias("status"),
        F.when(applicable > 0, _score(applicable, F.col("failed"))).alias("score"),
        F.when(applicable > 0, applicable).alias("applicable"),
        F.when(applicable > 0, F.col("failed")).alias("failed"),
    )


def level_scores(breakdown: DataFrame) -> DataFrame:
    """G3 totals: mean of the metric scores that exist, per column, table and dataset."""
    return breakdown.groupBy("level", "table_name", "column_name").agg(
        F.round(F.avg("score"), 2).alias("level_score"),
        F.count("score").alias("evaluated_metrics"),
        F.coalesce(F.sum("applicable"), F.lit(0)).alias("applicable_total"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_total"),
    )


def version_pairs(versions: DataFrame) -> DataFrame:
    """each version with the one before it in the same dataset as its baseline.

    The window runs inside one dataset's version list, which grows by hand.
    """
    w = Window.partitionBy("dataset_id").orderBy("version_number")
    return versions.withColumn(
        "baseline_version", F.lag("version_number").over(w)
    ).filter(F.col("baseline_version").isNotNull())
