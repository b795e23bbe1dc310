"""Date profile: text that holds dates, and true date columns."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqloom.functions import dates as dt
from dqloom.functions import names
from dqloom.functions.missing import strip
from dqloom.operators.counts import percent, wide_to_long
from dqloom.operators.frequency import Field, column_name, fields_of, text_values
from dqloom.operators.ranks import with_ranges

DATE_SHARE = 95.0
# Formats that read the same digits as day/month or month/day.
AMBIGUOUS_PAIRS = (("%d/%m/%Y", "%m/%d/%Y"), ("%d-%m-%Y", "%m-%d-%Y"))
AMBIGUOUS = ("%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%d.%m.%Y")
YEAR_FIRST = ("%Y-%m-%d", "%Y/%m/%d", dt.COMPACT_FORMAT)


def _as_of(as_of: str | datetime.datetime) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def _weighted(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col("cnt"))), F.lit(0))


def _format_choice(rates: dict[str, Column], first: Column, second: Column) -> Column:
    """struct<format, confidence>: which of the surviving formats to read with."""
    def pick(fmt: str, confidence: float | Column) -> Column:
        value = F.lit(confidence) if isinstance(confidence, float) else confidence
        return F.struct(F.lit(fmt).alias("format"), value.alias("confidence"))

    ok = {fmt: rate >= DATE_SHARE for fmt, rate in rates.items()}
    choice = F.when(F.lit(False), pick("", 0.0))
    for fmt in YEAR_FIRST:
        choice = choice.when(ok[fmt], pick(fmt, 100.0))
    for day_first, month_first in AMBIGUOUS_PAIRS:
        either = ok[day_first] | ok[month_first]
        choice = (
            choice.when(either & (first > 12), pick(day_first, 100.0))
            .when(either & (second > 12), pick(month_first, 100.0))
            .when(ok[day_first] & ok[month_first], pick(month_first, 50.0))
            .when(ok[day_first], pick(day_first, 100.0))
            .when(ok[month_first], pick(month_first, 100.0))
        )
    dotted = "%d.%m.%Y"
    choice = choice.when(ok[dotted] & ((first > 12) | (second <= 12)), pick(dotted, 100.0))
    rest = [f for f in rates if f not in YEAR_FIRST and f not in AMBIGUOUS]
    ranked = F.array_max(
        F.array(*[F.when(ok[f], F.struct(rates[f].alias("r"), F.lit(f).alias("f"))) for f in rest])
    )
    best = F.struct(ranked["f"].alias("format"), ranked["r"].alias("confidence"))
    return choice.when(ranked.isNotNull(), best)


def detect_formats(values: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """D1, D2 per position: format, confidence and ambiguity of date-like text.

    At least 95% of the rows must have a date shape and at least 95% of the
    distinct values must parse under one format. The shape test runs first; values
    of other columns are never parsed.
    """
    text = strip(F.col("value"))
    shaped = values.select("pos", text.alias("text"), "cnt").withColumn(
        "shaped", F.col("text").rlike(dt.DATE_SHAPE)
    )
    shares = shaped.groupBy("pos").agg(
        F.sum("cnt").alias("n"), _weighted(F.col("shaped")).alias("date_like_count"),
        F.bool_and(F.col("text").rlike(r"^\d{8}$")).alias("all_compact"),
    )
    date_like = percent(F.col("date_like_count"), F.col("n"))
    survivors = shares.withColumn("date_like_percentage", date_like).filter(
        F.col("date_like_percentage") >= DATE_SHARE
    ).withColumn("column_name", column_name(fields))
    compact_ok = F.col("all_compact") & names.has_token(
        F.col("column_name"), names.COMPACT_DATE_TOKENS
    )
    survivors = survivors.withColumn("compact_ok", compact_ok)
    # One row per table column on the broadcast side.
    trial = shaped.join(F.broadcast(survivors.select("pos", "compact_ok")), "pos")
    t, bare = F.col("text"), F.col("bare")
    formats = [fmt for fmt, _ in dt.DATE_FORMATS]
    rate_columns = [
        (F.count_if(dt.parse_date_part(bare, fmt).isNotNull()) / F.count(F.lit(1)) * 100).alias(
            f"rate_{i}")
        for i, fmt in enumerate(formats)
    ]
    compact = F.count_if(F.col("compact_ok") & dt.parse_date_part(bare, dt.COMPACT_FORMAT).isNotNull())
    part = r"^(\d{1,2})[-/.](\d{1,2})[-/.]"
    distinct = trial.select("pos", "text", "compact_ok").distinct().withColumn(
        "bare", dt.without_clock(t)
    )
    rates = distinct.groupBy("pos").agg(
        *rate_columns,
        (compact / F.count(F.lit(1)) * 100).alias(f"rate_{len(formats)}"),
        F.max(F.regexp_extract(t, part, 1).try_cast("int")).alias("first_part"),
        F.max(F.regexp_extract(t, part, 2).try_cast("int")).alias("second_part"),
    )
    every = {fmt: F.col(f"rate_{i}") for i, fmt in enumerate([*formats, dt.COMPACT_FORMAT])}
    zero = F.lit(0)
    choice = _format_choice(
        every, F.coalesce("first_part", zero), F.coalesce("second_part", zero)
    )
    chosen = rates.withColumn("choice", choice).select(
        "pos", F.col("choice.format").alias("detected_format"),
        F.col("choice.confidence").alias("format_confidence_percentage"),
    ).filter(F.col("detected_format").isNotNull())
    ambiguous = F.col("detected_format").isin(*AMBIGUOUS) & (
        F.col("format_confidence_percentage") < 100
    )
    return chosen.join(F.broadcast(survivors), "pos").select(
        "pos", "column_name", "n", "date_like_count", "date_like_percentage",
        "detected_format", "format_confidence_percentage", ambiguous.alias("format_ambiguous"),
    )


def detected_pattern(fmt: Column) -> Column:
    """The Spark pattern of a detected format."""
    known = [f for f, _ in dt.DATE_FORMATS] + [dt.COMPACT_FORMAT]
    pairs = [F.lit(x) for f in known for x in (f, dt.spark_pattern(f))]
    return F.element_at(F.create_map(*pairs), fmt)


def date_statistics(
    values: DataFrame, detected: DataFrame, as_of: str | datetime.datetime
) -> DataFrame:
    """D3 per position of date-like text."""
    # One row per date-like table column on the broadcast side.
    patterns = detected.drop("column_name").withColumn(
        "pattern", detected_pattern(F.col("detected_format"))
    )
    dated = values.join(F.broadcast(patterns), "pos").withColumn("text", strip(F.col("value")))
    parsed = dated.withColumn(
        "ts",
        F.when(
            F.col("text").rlike(dt.DATE_SHAPE),
            F.try_to_timestamp(dt.without_clock(F.col("text")), F.col("pattern")),
        ),
    )
    good = F.col("ts").isNotNull()
    clock = F.col("text").rlike(r"[ T]\d{1,2}:\d{2}")
    # Distinct dates are few next to rows, so they are folded first.
    days = parsed.groupBy(
        "pos", "ts", "n", "date_like_count", "date_like_percentage", "detected_format",
        "format_confidence_percentage", "format_ambiguous",
    ).agg(F.sum("cnt").alias("cnt"), F.bool_or(clock & good).alias("clock"))
    keys = ["pos", "n", "date_like_count", "date_like_percentage", "detected_format",
            "format_confidence_percentage", "format_ambiguous"]
    out = days.groupBy(*keys).agg(
        _weighted(F.col("ts").isNotNull()).alias("count"),
        F.min("ts").alias("min"), F.max("ts").alias("max"),
        F.count("ts").alias("distinct_dates"),
        F.bool_or("clock").alias("has_time_component"),
        _weighted(F.col("ts") > _as_of(as_of)).alias("future"),
    ).filter(F.col("count") > 0)
    return out.select(
        *keys, "count", "min", "max",
        ((F.unix_micros("max") - F.unix_micros("min")) / 86_400_000_000).alias("span_days"),
        "distinct_dates", "has_time_component",
        percent(F.col("future"), F.col("count")).alias("future_date_percentage"),
        percent(F.col("count"), F.col("n")).alias("parse_success_percentage"),
        (F.col("n") - F.col("count")).alias("null_or_unparseable_count"),
    )


def detect_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D1, D2 for the text columns of a table."""
    values, fields = text_values(df, columns)
    return detect_formats(values, fields).drop("pos")


def date_profile(
    df: DataFrame, as_of: str | datetime.datetime, columns: Sequence[str] | None = None
) -> DataFrame:
    """D3 for the date-like text columns of a table."""
    values, fields = text_values(df, columns)
    stats = date_statistics(values, detect_formats(values, fields), as_of)
    rest = [c for c in stats.columns if c not in ("pos", "n")]
    return stats.select(column_name(fields).alias("column_name"), *rest)


def datetime_statistics(
    df: DataFrame, as_of: str | datetime.datetime, columns: Sequence[str] | None = None
) -> DataFrame:
    """D4 per position of true date and timestamp columns."""
    fields = fields_of(df, columns, ["datetime"])

    def ts(f):
        return f.value.cast("timestamp")

    long = wide_to_long(
        df, fields,
        {
            "rows": lambda f: F.count(F.lit(1)),
            "count": lambda f: F.count(f.value),
            "min": lambda f: F.min(ts(f)),
            "max": lambda f: F.max(ts(f)),
            "has_time_component": lambda f: F.bool_or(ts(f) != F.date_trunc("day", ts(f))),
            "future": lambda f: F.count_if(ts(f) > _as_of(as_of)),
        },
    ).filter(F.col("count") > 0)
    return long.select(
        "pos", "count", "min", "max",
        percent(F.col("count"), F.col("rows")).alias("format_valid_percentage"),
        "has_time_component",
        percent(F.col("future"), F.col("count")).alias("future_date_percentage"),
        ((F.unix_micros("max") - F.unix_micros("min")) / 86_400_000_000).alias("span_days"),
    )


def datetime_profile(
    df: DataFrame, as_of: str | datetime.datetime, columns: Sequence[str] | None = None
) -> DataFrame:
    """D4 with exact distinct dates."""
    from dqloom.operators.frequency import unpivot

    fields = fields_of(df, columns, ["datetime"])
    distinct = unpivot(df, fields).groupBy("pos", "s").agg(F.lit(1).alias("one")).groupBy(
        "pos"
    ).agg(F.count(F.lit(1)).alias("distinct_dates"))
    stats = datetime_statistics(df, as_of, columns).join(F.broadcast(distinct), "pos")
    rest = [c for c in stats.columns if c != "pos"]
    return stats.select(column_name(fields).alias("column_name"), *rest)


def monotonic(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Does `column` never fall / never rise along `order_by`?

    Rows are first folded to one (min, max) per order value, so a hot order value
    is a single row. Neighbours are then compared inside ranges of the order and
    between the edges of consecutive ranges; no task sees a whole column. Rows
    that share an order value may be read in either direction.
    """
    from dqloom.functions.missing import quoted

    key = quoted(order_by)
    v = quoted(column)
    folded = (
        df.select(key.alias("o"), v.alias("v"))
        .filter(F.col("o").isNotNull() & F.col("v").isNotNull())
        .groupBy("o")
        .agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        .withColumn("g", F.lit(0))
        .withColumn("w", F.lit(1))
    )
    if isinstance(df.schema[order_by].dataType, T.NumericType):
        ranged = with_ranges(folded, ["g"], "o", "w")
    else:
        # Text, dates and times have no sketch; Spark's range partitioning cuts them.
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = folded.repartitionByRange(width, "o").withColumn("rng", F.spark_partition_id())
    inside = Window.partitionBy("g", "rng").orderBy("o")
    steps = ranged.withColumn("p_lo", F.lag("lo").over(inside)).withColumn(
        "p_hi", F.lag("hi").over(inside)
    )
    per_range = steps.groupBy("g", "rng").agg(
        F.bool_and(F.coalesce(F.col("p_hi") <= F.col("lo"), F.lit(True))).alias("up"),
        F.bool_and(F.coalesce(F.col("p_lo") >= F.col("hi"), F.lit(True))).alias("down"),
        F.min("lo").alias("r_lo"), F.max("hi").alias("r_hi"),
    )
    # One row per range from here on.
    between = Window.partitionBy("g").orderBy("rng")
    edges = per_range.withColumn("p_hi", F.lag("r_hi").over(between)).withColumn(
        "p_lo", F.lag("r_lo").over(between)
    )
    up = F.bool_and(F.col("up") & F.coalesce(F.col("p_hi") <= F.col("r_lo"), F.lit(True)))
    down = F.bool_and(F.col("down") & F.coalesce(F.col("p_lo") >= F.col("r_hi"), F.lit(True)))
    return edges.agg(
        up.alias("monotonic_increasing"), down.alias("monotonic_decreasing")
    ).select(F.lit(column).alias("column_name"), "monotonic_increasing", "monotonic_decreasing")
