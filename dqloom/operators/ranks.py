"""Exact rank operators without putting a whole column into one task.

Values are cut into ranges at approximate quantile points. They come from KLL sketches:
every map task builds one per column, groups of tasks merge theirs, and the few merged ones
are merged again, so no task reads a sketch from every other task. A sketch has a fixed
size. Range totals give every range its rank offset; only then are rows ordered, inside one
range at a time. The cut points steer the work and never the answer, so the result is exact
whatever the sketch says. Sketches of the same values differ from run to run, so cut points
that more than one step reads are evaluated once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqloom.session import shuffle_width

MAX_RANGES = 16_384
SKETCH_LEAST, SKETCH_MOST = 400, 65_535


def _number_below(frame: DataFrame, bounds: str, v: str, most: int, name: str) -> DataFrame:
    """Add `name`: how many of a row's sorted bounds (`most` at most) lie below v, by a binary
    search of plain expressions. A step per projection, as each reads the one before twice."""
    frame = frame.withColumn(name, F.lit(0))
    for step in (1 << i for i in reversed(range(most.bit_length()))):
        at = F.col(name)
        frame = frame.withColumn(name, F.when(F.get(bounds, at + (step - 1)) < F.col(v), at + step).otherwise(at))
    return frame


def cut_points(
    values: DataFrame, group: Sequence[str], order: str, weight: str, points: Sequence[float]
) -> DataFrame:
    """(group…, flat): the values near the wanted shares of the rows with a weight, null
    where no row has one."""
    k = min(SKETCH_MOST, max(SKETCH_LEAST, 4 * len(points)))
    # Tasks are dealt to about the square root of their number of merging groups.
    merging = max(1, math.isqrt(shuffle_width(values.sparkSession)))
    number = F.when(F.col(weight) > 0, F.col(order).cast("double"))
    parts = values.groupBy(*group, F.pmod(F.spark_partition_id(), F.lit(merging)).alias("part")).agg(
        F.kll_sketch_agg_double(number, k).alias("sketch"))
    whole = parts.groupBy(*group).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    some = F.kll_sketch_get_n_double("sketch") > 0
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in points]))
    return whole.select(*group, F.when(some, found).alias("flat"))


def with_ranges(
    values: DataFrame, group: Sequence[str], order: str, weight: str, max_ranges: int = MAX_RANGES,
    fixed: bool = False,
) -> DataFrame:
    """Add `rng`: ranges of `order` in ascending order, about evenly filled with rows.

    `fixed`: evaluate the cut points now, so that every step that reads the frame sees the
    same ranges.
    """
    ranges = min(shuffle_width(values.sparkSession), max_ranges)
    points = [i / ranges for i in range(1, ranges)]
    bounds = cut_points(values, group, order, weight, points).select(
        *group, F.array_sort(F.array_distinct(F.col("flat"))).alias("bounds"))
    # One row of at most `max_ranges` numbers per column of the table: small by
    # construction, whatever the number of rows.
    if fixed:
        bounds = values.sparkSession.createDataFrame(bounds.toArrow())
    joined = values.join(F.broadcast(bounds), list(group))
    return _number_below(joined, "bounds", order, len(points), "rng").drop("bounds")


def range_offsets(
    ranged: DataFrame, group: Sequence[str], weights: Sequence[str]
) -> DataFrame:
    """Per range: weight sum, running sum before it and the group total."""
    sums = ranged.groupBy(*group, "rng").agg(*[F.sum(w).alias(f"{w}_sum") for w in weights])
    before = Window.partitionBy(*group).orderBy("rng").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*group)
    out = sums
    for w in weights:
        out = out.withColumn(
            f"{w}_before", F.coalesce(F.sum(f"{w}_sum").over(before), F.lit(0))
        ).withColumn(f"{w}_total", F.sum(f"{w}_sum").over(whole))
    return out


def exact_quantiles(
    values: DataFrame, group: Sequence[str], probabilities: Sequence[float],
    order: str = "v", weight: str = "cnt",
) -> DataFrame:
    """(group…, p, q): linearly interpolated quantiles of weighted values.

    After the range totals are known, only the few ranges that hold a wanted rank
    are shuffled and ordered.
    """
    group = list(group)
    ranged = with_ranges(values.select(*group, order, weight), group, order, weight, fixed=True)
    offsets = range_offsets(ranged, group, [weight])
    before, total, size = (F.col(f"{weight}_{n}") for n in ("before", "total", "sum"))
    p_list = F.array(*[F.lit(float(p)) for p in probabilities])
    wanted = (
        offsets.withColumn("p", F.explode(p_list))
        .withColumn("h", (total - 1) * F.col("p"))
        .withColumn(
            "k",
            F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h")))),
        )
        .filter((F.col("k") >= before) & (F.col("k") < before + size))
        .select(*group, "rng", "p", "h", "k", before.alias("start"))
    )
    needed = wanted.select(*group, "rng").distinct()
    running = Window.partitionBy(*group, "rng").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = (
        ranged.join(F.broadcast(needed), [*group, "rng"], "left_semi")
        .withColumn("upto", F.sum(weight).over(running))
    )
    hit = (
        placed.join(F.broadcast(wanted), [*group, "rng"])
        .filter(
            (F.col("k") < F.col("start") + F.col("upto"))
            & (F.col("k") >= F.col("start") + F.col("upto") - F.col(weight))
        )
    )
    low, high = F.min(order), F.max(order)
    fraction = F.max(F.col("h") - F.floor("h"))
    return hit.groupBy(*group, "p").agg(
        F.when(low == high, low).otherwise(low + (high - low) * fraction).alias("q")
    )


def folded_median(folded: DataFrame, group: str, order: str = "v", weight: str = "cnt") -> DataFrame:
    """(group, median) of a histogram: one row per group and value, few enough of a group's
    values to be ordered in one task."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start, h = F.col("start"), (F.col("total") - 1) / 2
    placed = folded.select(
        group, F.col(order).alias("v"), F.col(weight).alias("n"),
        F.coalesce(F.sum(weight).over(before), F.lit(0)).alias("start"),
        F.sum(weight).over(Window.partitionBy(group)).alias("total"))
    hit = placed.filter((F.floor(h) < start + F.col("n")) & (F.ceil(h) >= start))
    return hit.groupBy(group).agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def quantile_columns(
    quantiles: DataFrame, group: Sequence[str], names: dict[float, str]
) -> DataFrame:
    """One row per group with a named column per probability."""
    return quantiles.groupBy(*group).agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in names.items()]
    )


def largest_cdf_gap(
    values: DataFrame, group: Sequence[str], left: str, right: str, order: str = "v"
) -> DataFrame:
    """(group…, left_total, right_total, gap): two-sample Kolmogorov-Smirnov distance.

    `values` holds one row per (group, value) with both sides' counts.
    """
    group = list(group)
    both = values.select(*group, order, left, right).withColumn("w", F.col(left) + F.col(right))
    ranged = with_ranges(both, group, order, "w", fixed=True)
    offsets = range_offsets(ranged, group, [left, right])
    running = Window.partitionBy(*group, "rng").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = ranged.withColumn("lu", F.sum(left).over(running)).withColumn(
        "ru", F.sum(right).over(running)
    )
    # One row per range and column: bounded by MAX_RANGES, so it is broadcast.
    placed = summed.join(F.broadcast(offsets), [*group, "rng"])
    lt, rt = F.col(f"{left}_total"), F.col(f"{right}_total")
    gap = F.abs(
        (F.col(f"{left}_before") + F.col("lu")) / lt
        - (F.col(f"{right}_before") + F.col("ru")) / rt
    )
    return placed.groupBy(*group).agg(
        F.max(lt).alias("left_total"),
        F.max(rt).alias("right_total"),
        F.max(F.when((lt > 0) & (rt > 0), gap)).alias("gap"),
    )
