"""Running rule suites: rules -> results -> scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dqloom.operators.rules import (
    EXAMPLE_ROWS,
    Context,
    RuleError,
    failure_examples,
    is_row_rule,
    parameters,
    row_rule,
    row_rule_counts,
    template_of,
    with_rates,
)
from dqloom.operators.setrules import fused_counts, set_rule
from dqloom.plans.profile import small

RULE_SCHEMA = (
    "rule_id string, table_name string, column_name string, metric string, "
    "template string, status string"
)
COUNTS_SCHEMA = (
    "rule_id string, total_rows long, applicable_rows long, failed_rows long, "
    "error_message string"
)


def rule_column(rule: Mapping[str, Any]) -> str:
    """The column a rule is reported under."""
    params = parameters(rule)
    return (
        rule.get("column") or (list(rule.get("columns") or []) or [None])[0]
        or params.get("child_column") or params.get("left_column")
        or params.get("determinant_column") or "(table)"
    )


def rule_frame(spark: SparkSession, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    rows = [
        (
            str(r["rule_id"]), r["table"], rule_column(r), r.get("metric", "validity"),
            str(r.get("rule_template") or r.get("template") or r.get("type")),
            r.get("status", "approved"),
        )
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def failing_rows(df: DataFrame, rule: Mapping[str, Any], ctx: Context) -> DataFrame:
    """The rows of `df` that fail a rule."""
    if is_row_rule(rule):
        return df.filter(row_rule(df, rule, ctx).failed)
    return set_rule(df, rule, ctx).failing_rows()


def rule_counts(df: DataFrame, rule: Mapping[str, Any], ctx: Context) -> DataFrame:
    """One rule's counts and rates as one row."""
    if is_row_rule(rule):
        counts = row_rule_counts(df, {"r": row_rule(df, rule, ctx)}).drop("rule_id")
    else:
        counts = set_rule(df, rule, ctx).counts()
    return with_rates(counts)


def run_rules(
    spark: SparkSession, rules: Sequence[Mapping[str, Any]], ctx: Context
) -> DataFrame:
    """Results of all approved rules; a rule that cannot run is an error row.

    Row-level rules of one table share a scan, and so do its set-level rules, with one
    grouping for all of them. The tables' frames are evaluated here, at the same time; they
    have one row per rule. If a shared scan fails on some value, its rules run one by one
    and only the failing ones become errors.
    """
    approved = [r for r in rules if r.get("status", "approved") == "approved"]
    parts: list[DataFrame] = []
    errors: list[tuple] = []
    by_table: dict[str, list[Mapping[str, Any]]] = {}
    for r in approved:
        by_table.setdefault(r["table"], []).append(r)

    def attempt(rule_id: str, counts: Callable[[], DataFrame]) -> None:
        try:
            parts.append(small(counts().select(
                F.lit(rule_id).alias("rule_id"), "total_rows", "applicable_rows",
                "failed_rows", F.lit(None).cast("string").alias("error_message"),
            )))
        except Exception as problem:  # noqa: BLE001 - any failure is an error result
            errors.append((rule_id, None, None, None, str(problem)[:200]))

    shared: list[tuple[DataFrame, dict[str, Callable[[], DataFrame]]]] = []
    for table, members in by_table.items():
        df = ctx.tables.get(table)
        rows, sets = {}, {}
        for r in members:
            rule_id = str(r["rule_id"])
            try:
                if df is None:
                    raise RuleError(f"the table {table!r} is not loaded")
                if is_row_rule(r):
                    row = row_rule(df, r, ctx)
                    df.select(row.applicable, row.failed)
                    rows[rule_id] = row
                else:
                    keyed = set_rule(df, r, ctx)
                    keyed.keyed()
                    sets[rule_id] = keyed
            except Exception as problem:  # noqa: BLE001
                errors.append((rule_id, None, None, None, str(problem)[:200]))
        fused = {i: k for i, k in sets.items() if k.broken is not None}
        if rows:
            shared.append((row_rule_counts(df, rows), {i: lambda row=row, df=df: row_rule_counts(df, {"r": row}) for i, row in rows.items()}))
        if fused:
            shared.append((fused_counts(df, fused), {i: k.counts for i, k in fused.items()}))
        for rule_id, keyed in sets.items():
            if rule_id not in fused:
                attempt(rule_id, keyed.counts)

    def evaluated(counts: DataFrame) -> DataFrame | None:
        try:
            return small(counts.withColumn("error_message", F.lit(None).cast("string")))
        except Exception:  # noqa: BLE001 - one of its rules failed: which, only single runs tell
            return None

    with ThreadPoolExecutor(max_workers=8) as pool:
        found = list(pool.map(evaluated, [counts for counts, _ in shared]))
    for part, (_, single) in zip(found, shared, strict=True):
        if part is not None:
            parts.append(part)
        else:
            for rule_id, counts in single.items():
                attempt(rule_id, counts)
    out = spark.createDataFrame(errors, COUNTS_SCHEMA)
    for part in parts:
        out = out.unionByName(part)
    status = F.when(F.col("error_message").isNull(), "passed").otherwise("error")
    described = rule_frame(spark, approved).drop("status")
    # One row per rule on both sides.
    return described.join(
        with_rates(out.withColumn("status", status)), "rule_id"
    )


def rule_examples(
    rules: Sequence[Mapping[str, Any]], ctx: Context, keys: Mapping[str, str],
    limit: int = EXAMPLE_ROWS,
) -> DataFrame | None:
    """Up to `limit` failing rows per approved rule as (rule_id, place, example).

    `keys` names a column per table whose order decides which rows are shown; tables it
    leaves out show any.
    """
    out: DataFrame | None = None
    for rule in rules:
        if rule.get("status", "approved") != "approved" or ctx.tables.get(rule["table"]) is None:
            continue
        df = ctx.tables[rule["table"]]
        key = keys.get(rule["table"])
        shown = failure_examples(failing_rows(df, rule, ctx), limit, key)
        # At most `limit` rows from here on.
        place = F.row_number().over(Window.orderBy(F.col("key") if key else F.lit(0)))
        part = shown.withColumn("key", shown["example"][key].cast(df.schema[key].dataType) if key else F.lit(0)).select(
            F.lit(str(rule["rule_id"])).alias("rule_id"), place.alias("place"), "example"
        )
        out = part if out is None else out.unionByName(part)
    return out


def supported_templates() -> list[str]:
    from dqloom.operators.rules import ROW_TEMPLATES
    from dqloom.operators.setrules import SET_TEMPLATES

    return sorted([*ROW_TEMPLATES, *SET_TEMPLATES])


__all__ = [
    "failing_rows", "rule_column", "rule_counts", "rule_examples", "rule_frame", "run_rules",
    "supported_templates", "template_of",
]
