"""Drift between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.operators.frequency import (
    Field,
    column_name,
    display_text,
    fields_of,
    number_value,
    unpivot,
)
from dqloom.operators.ranks import largest_cdf_gap

MIN_SAMPLE = 30
KS_THRESHOLD = 0.15
PSI_THRESHOLD = 0.2
EPSILON = 1e-6


def schema_changes(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """columns added, removed or retyped."""
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = [(f.name, f.dtype.simpleString()) for f in fields_of(df)]
        return df.sparkSession.createDataFrame(rows, f"column_name string, {name} string")

    joined = side(baseline, "baseline_type").join(
        side(comparison, "comparison_type"), "column_name", "full"
    )
    b, c = F.col("baseline_type"), F.col("comparison_type")
    change = F.when(b.isNull(), "added").when(c.isNull(), "removed").when(b != c, "retyped")
    return joined.withColumn("change", change).filter(F.col("change").isNotNull())


def _shared(baseline: DataFrame, comparison: DataFrame) -> tuple[list[Field], list[Field]]:
    """(numeric on both sides, everything else on both sides)."""
    other = {f.name: f for f in fields_of(comparison)}
    both = [f for f in fields_of(baseline) if f.name in other]
    numeric = [f for f in both if f.kind == "numeric" and other[f.name].kind == "numeric"]
    return numeric, [f for f in both if f not in numeric]


def _aligned(df: DataFrame, fields: list[Field]) -> list[Field]:
    """The same columns of another table under the baseline's positions."""
    types = {f.name: f.dtype for f in fields_of(df)}
    return [Field(f.pos, f.name, types[f.name]) for f in fields]


def paired_frequencies(
    baseline: DataFrame, comparison: DataFrame, fields: list[Field], numeric: bool
) -> DataFrame:
    """(pos, v, b, c): both versions' counts per value, in one aggregation."""
    def side(df: DataFrame, b: int, c: int) -> DataFrame:
        value = number_value() if numeric else display_text()
        return unpivot(df, _aligned(df, fields)).select(
            "pos", value.alias("v"), F.lit(b).cast("long").alias("b"),
            F.lit(c).cast("long").alias("c"),
        )

    rows = side(baseline, 1, 0).unionByName(side(comparison, 0, 1))
    return rows.groupBy("pos", "v").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))


def ks_drift(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """two-sample Kolmogorov-Smirnov distance per numeric column."""
    fields, _ = _shared(baseline, comparison)
    pairs = paired_frequencies(baseline, comparison, fields, numeric=True)
    gaps = largest_cdf_gap(pairs, ["pos"], "b", "c")
    return gaps.select(
        column_name(fields).alias("column_name"), F.lit("ks").alias("method"),
        F.col("left_total").alias("baseline_count"),
        F.col("right_total").alias("comparison_count"), F.col("gap").alias("statistic"),
        F.lit(KS_THRESHOLD).alias("threshold"),
    )


def psi_drift(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """population stability index per non-numeric column.

    Shares are smoothed by a small constant and scaled back to one, which only
    needs the column totals and the number of values.
    """
    _, fields = _shared(baseline, comparison)
    pairs = paired_frequencies(baseline, comparison, fields, numeric=False)
    totals = pairs.groupBy("pos").agg(
        F.sum("b").alias("bt"), F.sum("c").alias("ct"), F.count(F.lit(1)).alias("k")
    )
    scale = F.lit(1.0) + F.col("k") * EPSILON
    e = (F.col("b") / F.col("bt") + EPSILON) / scale
    a = (F.col("c") / F.col("ct") + EPSILON) / scale
    term = F.when((F.col("bt") > 0) & (F.col("ct") > 0), (a - e) * F.log(a / e))
    # One row per table column on the broadcast side.
    summed = pairs.join(F.broadcast(totals), "pos").groupBy("pos").agg(
        F.sum(term).alias("statistic"), F.max("bt").alias("baseline_count"),
        F.max("ct").alias("comparison_count"),
    )
    return summed.select(
        column_name(fields).alias("column_name"), F.lit("psi").alias("method"),
        "baseline_count", "comparison_count", "statistic",
        F.lit(PSI_THRESHOLD).alias("threshold"),
    )


def column_drift(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """Every shared column with its statistic and verdict.

    Fewer than 30 values on a side means `insufficient_sample`, not drift.
    """
    numeric, other = _shared(baseline, comparison)
    frames = []
    if numeric:
        frames.append(ks_drift(baseline, comparison))
    if other:
        frames.append(psi_drift(baseline, comparison))
    measured = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    # Columns without a single value on either side have no row yet.
    names = [(f.name, "ks", KS_THRESHOLD) for f in numeric] + [
        (f.name, "psi", PSI_THRESHOLD) for f in other
    ]
    shared = baseline.sparkSession.createDataFrame(
        names, "column_name string, method string, threshold double"
    )
    zero = F.lit(0).cast("long")
    both = shared.join(measured.drop("method", "threshold"), "column_name", "left").withColumns({
        "baseline_count": F.coalesce("baseline_count", zero),
        "comparison_count": F.coalesce("comparison_count", zero),
    })
    enough = F.least("baseline_count", "comparison_count") >= MIN_SAMPLE
    return both.select(
        "column_name", "method", "baseline_count", "comparison_count",
        F.when(enough, F.round("statistic", 4)).alias("statistic"), "threshold",
        F.when(enough, F.col("statistic") > F.col("threshold")).alias("drift_detected"),
        F.when(enough, "compared").otherwise("insufficient_sample").alias("status"),
    )


def drift_summary(drift: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """how many columns were compared, drifted or lacked data."""
    out = drift.agg(
        F.count_if(F.col("status") == "compared").alias("columns_compared"),
        F.count_if(F.coalesce(F.col("drift_detected"), F.lit(False))).alias("drift_columns"),
        F.count_if(F.col("status") == "insufficient_sample").alias("insufficient_sample_count"),
    )
    if schema is None:
        return out
    # Two single-row frames.
    return out.join(
        F.broadcast(schema.agg((F.count(F.lit(1)) > 0).alias("schema_changed")))
    )
