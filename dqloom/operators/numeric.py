"""Numeric column profile over (pos, v, cnt) frequency rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqloom.functions import names
from dqloom.operators.counts import (
    LOW_CARDINALITY,
    distinct_summary,
    percent,
    wide_to_long,
)
from dqloom.operators.frequency import (
    Field,
    column_name,
    fields_of,
    numeric_values,
    value_frequencies,
)
from dqloom.operators.ranks import exact_quantiles, quantile_columns

# Numbers commonly used as "no value".
SENTINELS = (-1, 0, 99, 999, 9999, -999, -9999, 99999)
SENTINEL_SHARE = 0.01
MAX_DECIMALS = 6
QUANTILES = {
    0.01: "p01", 0.05: "p05", 0.25: "q25", 0.5: "q50", 0.75: "q75", 0.95: "p95", 0.99: "p99",
}
INFINITY = float("inf")


def _finite(v: Column) -> Column:
    return F.abs(v) < F.lit(INFINITY)


def _vft(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return value_frequencies(df, columns, ["numeric"])


def _named(df: DataFrame, result: DataFrame) -> DataFrame:
    rest = [c for c in result.columns if c != "pos"]
    return result.select(column_name(fields_of(df)).alias("column_name"), *rest)


def _double(f: Field) -> Column:
    return f.value.cast("double")


def _whole(f: Field) -> Column:
    return F.bool_and(_finite(_double(f)) & (_double(f) == F.rint(_double(f))))


def _decimal_places(f: Field) -> Column:
    v = _double(f)
    chain = F.when(~_finite(v) | (v == F.rint(v)), F.lit(0))
    for places in range(1, MAX_DECIMALS + 1):
        scaled = F.round(v * F.lit(10.0**places), 6)
        chain = chain.when(F.abs(scaled - F.rint(scaled)) < F.lit(1e-6), F.lit(places))
    return F.max(chain.otherwise(F.lit(MAX_DECIMALS)))


MOMENTS = {
    "count": lambda f: F.count(_double(f)),
    "min": lambda f: F.min(_double(f)),
    "max": lambda f: F.max(_double(f)),
    "mean": lambda f: F.avg(_double(f)),
    "std": lambda f: F.stddev_samp(_double(f)),
    "raw_skew": lambda f: F.skewness(_double(f)),
    "zero_count": lambda f: F.count_if(_double(f) == 0),
    "negative_count": lambda f: F.count_if(_double(f) < 0),
    "positive_count": lambda f: F.count_if(_double(f) > 0),
    "integer_valued": _whole,
    "max_decimal_places": _decimal_places,
}


def moments(
    df: DataFrame, columns: Sequence[str] | None = None, wanted: Sequence[str] | None = None
) -> DataFrame:
    """N1, N5, N6, N7 per position in one map-side aggregation, no shuffle of values."""
    fields = fields_of(df, columns, ["numeric"])
    chosen = list(MOMENTS) if wanted is None else ["count", *wanted]
    if "raw_skew" in chosen and "std" not in chosen:
        chosen.append("std")
    out = wide_to_long(df, fields, {m: MOMENTS[m] for m in dict.fromkeys(chosen)}).filter(
        F.col("count") > 0
    )
    if "raw_skew" in chosen:
        out = out.withColumn("skewness", adjusted_skew()).drop("raw_skew")
    return out


def adjusted_skew() -> Column:
    n = F.col("count").cast("double")
    flat = F.col("std").isNull() | (F.col("std") == 0)
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(flat, F.lit(0.0))
        .otherwise(F.col("raw_skew") * F.sqrt(n * (n - 1)) / (n - 2))
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, min, max, mean, median, sample standard deviation."""
    median = quantile_columns(
        exact_quantiles(numeric_values(_vft(df, columns)), ["pos"], [0.5]), ["pos"], {0.5: "median"}
    )
    base = moments(df, columns, ["min", "max", "mean", "std"])
    return _named(df, base.join(F.broadcast(median), "pos", "left"))


def numeric_quantiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact p01 p05 q25 q50 q75 p95 p99 and the interquartile range."""
    q = exact_quantiles(numeric_values(_vft(df, columns)), ["pos"], list(QUANTILES))
    wide = quantile_columns(q, ["pos"], QUANTILES)
    return _named(df, wide.withColumn("iqr", F.col("q75") - F.col("q25")))


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str] | None = None, accuracy: int = 10_000
) -> DataFrame:
    """N2 by sketch, on request: one scan, no shuffle of values."""
    fields = fields_of(df, columns, ["numeric"])
    long = wide_to_long(
        df, fields,
        {
            n: (lambda f, p=p: F.percentile_approx(f.value.cast("double"), p, accuracy))
            for p, n in QUANTILES.items()
        },
    )
    return _named(
        df, long.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn(
            "approximate", F.lit(True)
        )
    )


def median_absolute_deviation(values: DataFrame, medians: DataFrame) -> DataFrame:
    """N3 per position; `medians` is (pos, q50)."""
    # One row per table column on the broadcast side.
    spread = values.join(F.broadcast(medians.select("pos", "q50")), "pos").select(
        "pos", F.abs(F.col("v") - F.col("q50")).alias("v"), "cnt"
    )
    return quantile_columns(exact_quantiles(spread, ["pos"], [0.5]), ["pos"], {0.5: "mad"})


def iqr_outliers(values: DataFrame, quartiles: DataFrame) -> DataFrame:
    """N4 per position; `quartiles` is (pos, q25, q75)."""
    fence = (F.col("q75") - F.col("q25")) * 1.5
    outside = (F.col("v") < F.col("q25") - fence) | (F.col("v") > F.col("q75") + fence)
    counted = values.join(F.broadcast(quartiles.select("pos", "q25", "q75")), "pos").groupBy(
        "pos"
    ).agg(
        F.coalesce(F.sum(F.when(outside, F.col("cnt"))), F.lit(0)).alias("outlier_count"),
        F.sum("cnt").alias("n"),
    )
    return counted.select(
        "pos", "outlier_count",
        percent(F.col("outlier_count"), F.col("n")).alias("outlier_percentage"),
    )


def numeric_mad(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    values = numeric_values(_vft(df, columns))
    medians = quantile_columns(exact_quantiles(values, ["pos"], [0.5]), ["pos"], {0.5: "q50"})
    # One row per table column, read by several steps.
    medians = df.sparkSession.createDataFrame(medians.toArrow())
    return _named(df, median_absolute_deviation(values, medians))


def numeric_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    values = numeric_values(_vft(df, columns))
    q = quantile_columns(
        exact_quantiles(values, ["pos"], [0.25, 0.75]), ["pos"], {0.25: "q25", 0.75: "q75"}
    )
    return _named(df, iqr_outliers(values, q))


def numeric_signs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Zero, negative and positive counts."""
    return _named(
        df, moments(df, columns, ["zero_count", "negative_count", "positive_count"]).drop("count")
    )


def numeric_skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-adjusted skewness."""
    return _named(df, moments(df, columns, ["raw_skew"]).select("pos", "skewness"))


def numeric_precision(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Integer-valued, decimal places (at most 6), low cardinality."""
    distinct = distinct_summary(_vft(df, columns)).select("pos", "distinct_count")
    base = moments(df, columns, ["integer_valued", "max_decimal_places"]).drop("count")
    joined = base.join(F.broadcast(distinct), "pos")
    return _named(
        df,
        joined.withColumn("low_cardinality", F.col("distinct_count") <= LOW_CARDINALITY).drop(
            "distinct_count"
        ),
    )


def sequence_summary(values: DataFrame) -> DataFrame:
    """N8 per position, without ordering the values.

    n distinct whole numbers between min and max have one constant step exactly
    when that step is (max - min) / (n - 1) and all of them are congruent to min.
    """
    v = F.col("v")
    whole = F.bool_and((v == F.rint(v)) & _finite(v))
    stats = values.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("rows"),
        F.min("v").alias("lo"), F.max("v").alias("hi"), whole.alias("whole"),
    )
    step = (F.col("hi") - F.col("lo")) / (F.col("n") - 1)
    stats = stats.withColumn("step", F.when(F.col("n") > 1, step))
    # One row per table column on the broadcast side.
    on_grid = values.join(F.broadcast(stats.select("pos", "lo", "step")), "pos").groupBy(
        "pos"
    ).agg(F.bool_and(F.pmod(v - F.col("lo"), F.col("step")) == 0).alias("on_grid"))
    usable = F.col("whole") & (F.col("n") > 1)
    constant_step = (
        usable & (F.col("step") == F.rint(F.col("step"))) & F.coalesce(F.col("on_grid"), F.lit(False))
    )
    unique = F.col("n") == F.col("rows")
    return stats.join(F.broadcast(on_grid), "pos", "left").select(
        "pos",
        (constant_step & (F.col("step") == 1)).alias("step_one"),
        (constant_step & (F.col("step") == 1) & unique).alias("dense"),
        (constant_step & unique & (F.col("lo") >= 0)).alias("counter_like"),
    ).select("pos", *[F.coalesce(F.col(c), F.lit(False)).alias(c)
                      for c in ("step_one", "dense", "counter_like")])


def integer_sequences(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _named(df, sequence_summary(numeric_values(_vft(df, columns))))


def code_like_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers that are labels — by name, or whole and counter- or key-like."""
    vft = _vft(df, columns)
    values = numeric_values(vft)
    base = (
        moments(df, columns, ["integer_valued"]).drop("count")
        .join(F.broadcast(sequence_summary(values)), "pos")
        .join(
            F.broadcast(distinct_summary(vft).select("pos", "distinct_count", "non_null_count")),
            "pos",
        )
        .withColumn("column_name", column_name(fields_of(df)))
    )
    name = F.col("column_name")
    strong = names.has_token(name, names.IDENTIFIER_STRONG_TOKENS)
    identifier = strong & (F.col("distinct_count") == F.col("non_null_count"))
    by_name = names.has_token(name, names.CODE_LIKE_TOKENS)
    return base.select(
        "column_name", "integer_valued", "counter_like", identifier.alias("identifier_signal"),
        (by_name | (F.col("integer_valued") & (F.col("counter_like") | identifier))).alias(
            "code_like"
        ),
    )


def sentinel_expression() -> tuple[Column, Column]:
    """(value, share %) of a suspicious top value, over distinct_summary columns."""
    top, share = F.col("top_number"), F.col("top_value_share")
    hit = top.isin([float(x) for x in SENTINELS]) & (share >= SENTINEL_SHARE)
    return F.when(hit, top.cast("long")), F.when(hit, share * 100)


def numeric_sentinels(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The most frequent value is a typical stand-in and covers at least 1%."""
    value, share = sentinel_expression()
    return _named(
        df,
        distinct_summary(_vft(df, columns)).select(
            "pos", value.alias("sentinel_value"), share.alias("sentinel_percentage")
        ),
    )


def digit_lengths(values: DataFrame) -> DataFrame:
    """(pos, digits, cnt) of whole-number values."""
    v = F.abs(F.col("v"))
    # Whole numbers that a long holds need no decimals.
    digits = F.when((v == F.rint(v)) & (v < F.lit(1e18)), F.length(v.cast("long").cast("string"))).otherwise(
        F.length(v.cast("decimal(38,0)").cast("string")))
    return values.groupBy("pos", digits.alias("digits")).agg(F.sum("cnt").alias("cnt"))


def leading_zero_summary(values: DataFrame) -> DataFrame:
    """N11 per position: modal digit length ≥ 80% while shorter values exist.

    Only meaningful for code-like whole-number columns; the caller filters.
    """
    lengths = digit_lengths(values)
    # At most one row per digit length and column from here on.
    ordered = Window.partitionBy("pos").orderBy(F.col("cnt").desc(), F.col("digits"))
    ranked = lengths.withColumn("r", F.row_number().over(ordered)).withColumn(
        "modal", F.first("digits").over(ordered)
    )
    out = ranked.groupBy("pos").agg(
        F.max("modal").alias("modal_length"),
        F.max(F.when(F.col("r") == 1, F.col("cnt"))).alias("modal_count"),
        F.sum("cnt").alias("n"),
        F.coalesce(F.sum(F.when(F.col("digits") < F.col("modal"), F.col("cnt"))), F.lit(0)).alias(
            "shorter"
        ),
        F.sort_array(
            F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "digits", "cnt")))
        ).alias("top"),
    )
    suspected = (
        (F.col("modal_count") / F.col("n") >= 0.8) & (F.col("shorter") > 0)
        & (F.col("modal_length") > 1)
    )
    return out.select(
        "pos", "modal_length", suspected.alias("leading_zero_loss_suspected"),
        F.when(suspected, F.col("shorter")).otherwise(F.lit(0)).alias("leading_zero_loss_count"),
        F.array_join(
            F.transform(
                "top",
                lambda t: F.concat(t["digits"].cast("string"), F.lit(":"), t["cnt"].cast("string")),
            ),
            ",",
        ).alias("digit_length_distribution"),
    )


def leading_zero_loss(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """N11 over the code-like columns of a table that hold whole numbers only."""
    whole = code_like_columns(df, columns).filter("code_like AND integer_valued")
    summary = _named(df, leading_zero_summary(numeric_values(_vft(df, columns))))
    # One row per table column on either side.
    return summary.join(F.broadcast(whole.select("column_name")), "column_name")
