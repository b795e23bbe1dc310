"""Whole-table profile: duplicate rows, completeness, keys and dependencies."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqloom.functions.missing import NESTED, quoted, value_text
from dqloom.operators import evidence
from dqloom.operators.combinations import combination_counts
from dqloom.operators.counts import percent
from dqloom.operators.frequency import Field, fields_of

COMPOSITE_UNIQUENESS = 95.0
COMPOSITE_NEAR_EXACT = 99.9
COMPOSITE_PIGEONHOLE = 0.5
COMPOSITE_COVERAGE = 0.5
COMPOSITE_MAX_COLUMNS = 3
COMPOSITES_PER_SCAN = 128
FD_COVERAGE = 98.0
FD_MIN_ROWS = 30
FD_UNIQUE_RATIO = 0.95
FD_SCHEMA = (
    "determinant string, dependent string, evaluated_rows long, violating_rows long, "
    "violating_groups long, coverage_percentage double, bidirectional boolean"
)
CO_MISSING_REPORTED = 3
VIOLATION_EXAMPLES = 3


def group_value(field: Field) -> Column:
    """A column in a form that can be grouped, compared and ordered."""
    if isinstance(field.dtype, (*NESTED, T.BinaryType)):
        return value_text(field.value, field.dtype)
    return field.value


def comparable(field: Field) -> Column:
    """A fixed-width stand-in that differs when values differ."""
    value = group_value(field)
    if field.kind in ("numeric", "datetime", "boolean"):
        return value
    return F.when(value.isNotNull(), F.xxhash64(value))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """B1: members of complete-duplicate groups, and the excess over one each.

    Rows meet under 128 bits of hash instead of all their columns; a null is told from
    the values beside it by its own flag.
    """
    parts: list[Column] = []
    for f in fields_of(df):
        parts += [group_value(f), group_value(f).isNull()]
    keys = df.select(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b"))
    groups = keys.groupBy("a", "b").count()
    repeated = F.col("count") > 1
    return groups.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(repeated, F.col("count"))), F.lit(0)).alias(
            "complete_duplicate_rows"
        ),
        F.coalesce(F.sum(F.when(repeated, F.col("count") - 1)), F.lit(0)).alias(
            "complete_duplicate_excess_count"
        ),
    )


def row_completeness(df: DataFrame) -> DataFrame:
    """B2: complete rows, rows with nulls, mean and minimum fill."""
    fields = fields_of(df)
    columns = len(fields)
    filled = sum((f.value.isNotNull().cast("int") for f in fields), F.lit(0))
    out = df.select(filled.alias("filled")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("filled") == columns).alias("fully_complete_rows"),
        F.avg("filled").alias("mean_filled"), F.min("filled").alias("min_filled"),
    )
    rows, complete = F.col("row_count"), F.col("fully_complete_rows")
    return out.select(
        "row_count", "fully_complete_rows",
        percent(complete, rows).alias("fully_complete_percentage"),
        (rows - complete).alias("rows_with_any_null"),
        F.coalesce(F.col("mean_filled") / columns * 100, F.lit(0.0)).alias(
            "average_filled_percentage_per_row"
        ),
        F.coalesce(F.col("min_filled") / columns * 100, F.lit(0.0)).alias(
            "emptiest_row_filled_percentage"
        ),
    )


def co_missing_patterns(df: DataFrame, k: int = CO_MISSING_REPORTED) -> DataFrame:
    """The k most frequent sets of two or more columns that are null together."""
    fields = sorted(fields_of(df), key=lambda f: f.name)
    missing = F.array_compact(
        F.array(*[F.when(f.value.isNull(), F.lit(f.name)) for f in fields])
    )
    patterns = (
        df.select(missing.alias("columns"))
        .filter(F.size("columns") >= 2)
        .groupBy("columns")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    return patterns.orderBy(F.col("row_count").desc(), F.array_join("columns", ",")).limit(k)


# --- composite uniqueness -------------------------------------------------


def composite_uniqueness(
    df: DataFrame, combinations: Sequence[Sequence[str]], row_count: int | None = None
) -> DataFrame:
    """B4 measures: exact distinct count of each listed column combination.

    Rows with a null member are left out of their combination. `COMPOSITES_PER_SCAN`
    combinations are measured in one scan. Rows meet under 96 bits of hash, which map tasks
    send sorted and packed; the row count, counted where it isn't given, says in how many ranges.
    """
    if len(combinations) > COMPOSITES_PER_SCAN:
        row_count = df.count() if row_count is None else row_count
        parts = [composite_uniqueness(df, combinations[at:at + COMPOSITES_PER_SCAN], row_count)
                 for at in range(0, len(combinations), COMPOSITES_PER_SCAN)]
        return functools.reduce(DataFrame.unionByName, parts)
    by_name = {f.name: f for f in fields_of(df)}
    out = combination_counts(
        df, [[group_value(by_name[c]) for c in combo] for combo in combinations], df.count() if row_count is None else row_count,
    ).select("combo", F.col("rows").alias("evaluated_row_count"), F.col("distinct").alias("composite_distinct_count"),
             F.col("repeated").alias("duplicate_composite_rows"))
    labels = F.array(*[F.array(*[F.lit(c) for c in combo]) for combo in combinations])
    share = percent(F.col("composite_distinct_count"), F.col("evaluated_row_count"))
    return out.select(
        F.element_at(labels, F.col("combo") + 1).alias("columns"), "evaluated_row_count",
        "composite_distinct_count", share.alias("composite_uniqueness_percentage"),
        "duplicate_composite_rows",
        (F.col("evaluated_row_count") - F.col("composite_distinct_count")).alias(
            "duplicate_composite_excess_count"
        ),
        (share >= COMPOSITE_NEAR_EXACT).alias("near_exact"),
    )


def composite_candidates(
    df: DataFrame, column_facts: Sequence[dict], row_count: int,
    max_evaluations: int | None = None, reported: int | None = None,
    width: int = COMPOSITE_MAX_COLUMNS,
) -> DataFrame:
    """Pairs, then triples (up to `width`), of columns that identify (nearly) every
    row; all of them, or the `reported` best.

    `column_facts` is one small dict per column: name, distinct_count,
    non_null_count, is_constant, is_float_measure, is_free_text, is_key_like. The
    pigeonhole bound (product of distinct counts) and minimality decide what could be
    a key; a negative cover from sampled rows refutes most of that, and the rest is
    counted exactly. The table is scanned twice for the cover, and once per size and
    `COMPOSITES_PER_SCAN` combinations that are left.
    There is no cap on evaluations unless one is asked for.
    """
    eligible = {
        c["column_name"]: c for c in column_facts
        if not (c["is_constant"] or c["is_float_measure"] or c["is_free_text"])
        and c["distinct_count"] >= 2 and c["non_null_count"] > 0
        and c["distinct_count"] / c["non_null_count"] < COMPOSITE_UNIQUENESS / 100
    }
    found: list[tuple] = []
    unique: set[frozenset[str]] = set()
    evaluated = 0
    fields = [f for f in fields_of(df) if f.name in eligible]
    distinct = [eligible[f.name]["distinct_count"] for f in fields]
    least = COMPOSITE_PIGEONHOLE * row_count
    width = min(width, len(fields))
    refuted = None
    for size in range(2, width + 1):
        chosen = [
            c for c in evidence.pigeonholed(distinct, size, least)
            if not any(frozenset(fields[i].name for i in s) in unique for s in itertools.combinations(c, size - 1))
        ]
        if not chosen:
            continue
        if refuted is None:
            refuted = evidence.refuted_keys(df, fields, distinct, row_count, width, 1 - COMPOSITE_UNIQUENESS / 100, COMPOSITE_PIGEONHOLE)
        combos = [tuple(fields[i].name for i in c) for c in chosen if c not in refuted]
        combos.sort(key=lambda c: (
            math.prod(eligible[x]["distinct_count"] for x in c),
            -sum(bool(eligible[x]["is_key_like"]) for x in c),
        ))
        if max_evaluations is not None:
            combos = combos[: max(0, max_evaluations - evaluated)]
        evaluated += len(combos)
        if not combos:
            continue
        # One small row per combination comes back to steer the next level.
        for r in composite_uniqueness(df, combos, row_count).collect():
            if (
                r["evaluated_row_count"] >= COMPOSITE_COVERAGE * row_count
                and r["composite_uniqueness_percentage"] >= COMPOSITE_UNIQUENESS
            ):
                members = r["columns"]
                unique.add(frozenset(members))
                key_like = [m for m in members if eligible[m]["is_key_like"]]
                product = float(math.prod(eligible[m]["distinct_count"] for m in members))
                found.append((
                    members, r["evaluated_row_count"], r["composite_distinct_count"],
                    r["composite_uniqueness_percentage"], r["duplicate_composite_rows"],
                    r["duplicate_composite_excess_count"], r["near_exact"], product, key_like,
                ))
    found.sort(key=lambda e: (-e[3], len(e[0]), -len(e[8]), -e[2], e[7], tuple(e[0])))
    return df.sparkSession.createDataFrame(
        found[:reported],
        "columns array<string>, evaluated_row_count long, composite_distinct_count long, "
        "composite_uniqueness_percentage double, duplicate_composite_rows long, "
        "duplicate_composite_excess_count long, near_exact boolean, "
        "distinct_product double, key_like_members array<string>",
    )


# --- functional dependencies ----------------------------------------------


def dependency_coverage(
    df: DataFrame, determinants: Sequence[str], dependents: Sequence[str] | None = None
) -> DataFrame:
    """B5 measures: coverage of A -> B for every listed pair.

    One aggregation per determinant answers all its dependents: a group of A breaks
    A -> B when min(B) differs from max(B), and it weighs count(B) rows. Text is
    compared by 64-bit hash, as fixed-width buffers keep the aggregation hash-based.
    """
    dependents = list(dependents or determinants)
    used = [f for f in fields_of(df) if f.name in {*determinants, *dependents}]
    at = {f.name: f.pos for f in used}
    # Two forms of each column: g for grouping, c for comparing. Expressions are
    # short SQL texts, since a table has columns squared of them.
    cells = df.select(
        *[group_value(f).alias(f"g{f.pos}") for f in used],
        *[comparable(f).alias(f"c{f.pos}") for f in used],
    )
    names = F.array(*[F.lit(next((f.name for f in used if f.pos == i), None))
                      for i in range(max(at.values(), default=0) + 1)])
    out: DataFrame | None = None
    for a in determinants:
        others = [at[b] for b in dependents if b != a]
        if not others:
            continue
        groups = cells.where(f"g{at[a]} IS NOT NULL").groupBy(f"g{at[a]}").agg(*[
            F.expr(f"{fn}(c{i}) AS {short}{i}")
            for i in others for fn, short in (("count", "n"), ("min", "lo"), ("max", "hi"))
        ])
        sums = groups.selectExpr(*[
            text for i in others for text in (
                f"coalesce(sum(n{i}), 0L) AS e{i}",
                f"coalesce(sum(CASE WHEN lo{i} <> hi{i} THEN n{i} END), 0L) AS v{i}",
                f"count_if(lo{i} <> hi{i}) AS g{i}",
            )
        ])
        rows = ", ".join(f"{i}, e{i}, v{i}, g{i}" for i in others)
        part = sums.selectExpr(
            f"{at[a]} AS a",
            f"stack({len(others)}, {rows}) AS (b, evaluated_rows, violating_rows, violating_groups)",
        )
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("evaluated_rows") > 0).select(
        F.element_at(names, F.col("a") + 1).alias("determinant"),
        F.element_at(names, F.col("b") + 1).alias("dependent"),
        "evaluated_rows", "violating_rows", "violating_groups",
        (F.lit(100.0) * (F.lit(1.0) - F.col("violating_rows") / F.col("evaluated_rows"))).alias(
            "coverage_percentage"),
    )


def plausible_dependencies(
    df: DataFrame, columns: Sequence[str], min_coverage: float = FD_COVERAGE, distinct: dict[str, int] | None = None,
    row_count: int | None = None,
) -> dict[str, list[str]]:
    """Dependents worth measuring per determinant: those that sampled rows don't refute.

    Distinct counts and the row count steer how much is looked at; they are estimated
    where they aren't given.
    """
    fields = [f for f in fields_of(df) if f.name in {*columns}]
    if distinct is None or row_count is None:
        facts = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(evidence.hashed(f)) for f in fields]).first()
        row_count, distinct = facts[0], {f.name: d for f, d in zip(fields, facts[1:], strict=True)}
    refuted = evidence.refuted_dependencies(df, fields, 1 - min_coverage / 100, [distinct[f.name] for f in fields], row_count)
    at = {f.name: i for i, f in enumerate(fields)}
    return {a: [b for b in columns if a != b and not refuted[at[a], at[b]]] for a in columns}


def measured_dependencies(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """B5 measures of the wanted pairs, in one grouping whatever the number of columns.

    A row is repeated once per determinant, with the hashes of that determinant's own
    dependents side by side. Groups are met by 128 bits of hash; within one, a dependent
    is broken when its least hash differs from its greatest, and weighs its rows.
    """
    wanted = {a: bs for a, bs in wanted.items() if bs}
    by_name = {f.name: f for f in fields_of(df)}
    slots = range(max(map(len, wanted.values()), default=0))
    used = sorted({b for bs in wanted.values() for b in bs})
    at = {b: i for i, b in enumerate(used)}
    keys = [(F.xxhash64(group_value(by_name[a])), F.xxhash64(F.lit("second"), group_value(by_name[a])), group_value(by_name[a]).isNotNull())
            for a in wanted]
    wide = df.select(
        *[F.when(there, k).alias(f"k{i}") for i, (k, _, there) in enumerate(keys)],
        *[F.when(there, k).alias(f"l{i}") for i, (_, k, there) in enumerate(keys)],
        *[evidence.hashed(by_name[b]).alias(f"c{i}") for b, i in at.items()], F.lit(None).cast("long").alias("none"))
    groups = ", ".join(
        f"(k{i}, l{i}, " + ", ".join(f"c{at[bs[j]]}" if j < len(bs) else "none" for j in slots) + f") AS `{i}`"
        for i, bs in enumerate(wanted.values()))
    values = ", ".join(f"p{j}" for j in slots)
    rows = df.sparkSession.sql(
        f"SELECT CAST(a AS INT) AS a, k, l, {values} FROM {{wide}} UNPIVOT ((k, l, {values}) FOR a IN ({groups}))", wide=wide)
    met = rows.where("k IS NOT NULL").groupBy("a", "k", "l").agg(*[
        F.expr(f"{fn}(p{j}) AS {short}{j}") for j in slots for fn, short in (("count", "n"), ("min", "lo"), ("max", "hi"))])
    sums = met.groupBy("a").agg(*[F.expr(text) for j in slots for text in (
        f"coalesce(sum(n{j}), 0L) AS e{j}", f"coalesce(sum(CASE WHEN lo{j} <> hi{j} THEN n{j} END), 0L) AS v{j}",
        f"count_if(lo{j} <> hi{j}) AS g{j}")])
    names = list(wanted)
    # One row per determinant comes back.
    out = [(names[r.a], b, r[f"e{j}"], r[f"v{j}"], r[f"g{j}"], 100.0 * (1.0 - r[f"v{j}"] / r[f"e{j}"]))
           for r in sums.collect() for j, b in enumerate(wanted[names[r.a]]) if r[f"e{j}"]]
    return df.sparkSession.createDataFrame(out, FD_SCHEMA.rsplit(",", 1)[0])


def functional_dependencies(
    df: DataFrame, determinants: Sequence[str], min_coverage: float = FD_COVERAGE,
    min_rows: int = FD_MIN_ROWS, distinct: dict[str, int] | None = None, row_count: int | None = None,
) -> DataFrame:
    """Pairs A -> B that hold on at least 98% of the rows, with direction.

    The table is scanned for a sample, for what refutes pairs, and once for all that is
    left; once more where the distinct counts aren't given.
    """
    wanted = plausible_dependencies(df, determinants, min_coverage, distinct, row_count)
    if not any(wanted.values()):
        return df.sparkSession.createDataFrame([], FD_SCHEMA)
    pairs = measured_dependencies(df, wanted).filter(F.col("coverage_percentage") >= min_coverage)
    # At most two rows per window: a pair of columns and its reverse.
    both = Window.partitionBy(
        F.least("determinant", "dependent"), F.greatest("determinant", "dependent")
    )
    return pairs.withColumn("bidirectional", F.count(F.lit(1)).over(both) == 2).filter(
        F.col("evaluated_rows") >= min_rows
    )


def reduce_dependencies(pairs: DataFrame) -> DataFrame:
    """Drop exact A -> C when exact A -> B and B -> C hold and C -> B does not.

    Works on pairs of column names, whose number depends on the width of the table.
    """
    exact = pairs.filter(F.col("coverage_percentage") >= 100).select("determinant", "dependent")
    ab = exact.select(F.col("determinant").alias("a"), F.col("dependent").alias("b"))
    bc = exact.select(F.col("determinant").alias("b"), F.col("dependent").alias("c"))
    cb = exact.select(F.col("determinant").alias("c"), F.col("dependent").alias("b"))
    implied = (
        ab.join(bc, "b").filter(F.col("a") != F.col("c"))
        .join(cb, ["c", "b"], "left_anti")
        .select(F.col("a").alias("determinant"), F.col("c").alias("dependent"))
        .distinct()
        .withColumn("implied", F.lit(True))
    )
    keep = F.col("implied").isNull() | (F.col("coverage_percentage") < 100)
    return pairs.join(implied, ["determinant", "dependent"], "left").filter(keep).drop("implied")


def dependency_violations(
    df: DataFrame, determinant: str, dependent: str, groups: int = VIOLATION_EXAMPLES,
    values: int = VIOLATION_EXAMPLES,
) -> DataFrame:
    """The first violating groups of A -> B with a few of their values each.

    Both limits are the size of the report. Broken groups are found by min <> max,
    so no group's values are gathered; only the reported ones are looked up.
    """
    by_name = {f.name: f for f in fields_of(df)}
    a, b = group_value(by_name[determinant]), group_value(by_name[dependent])
    pairs = df.select(a.alias("a"), b.alias("b")).filter(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    broken = (
        pairs.groupBy("a").agg(
            F.min(F.xxhash64("b")).alias("lo"), F.max(F.xxhash64("b")).alias("hi")
        ).filter(F.col("lo") != F.col("hi")).select("a").orderBy("a").limit(groups)
    )
    rank = Window.partitionBy("a").orderBy("b")
    shown = (
        pairs.join(F.broadcast(broken), "a").distinct()
        .withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= values)
    )
    return shown.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("dependent_values")).select(
        F.lit(determinant).alias("determinant"), F.lit(dependent).alias("dependent"),
        F.col("a").alias("determinant_value"), "dependent_values",
    )
