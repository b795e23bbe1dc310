"""Profile operators against pandas and plain Python on small frames."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from dqloom.functions.missing import WHITESPACE
from dqloom.operators import counts, dates, drift, numeric, ranks, tables, text
from dqloom.plans.profile import column_profile, profile_table


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_counts_keep_null_empty_and_blank_apart(spark):
    df = spark.createDataFrame([("a",), (None,), ("",), ("   ",), (" b",)], "value string")
    n = counts.null_counts(df).first()
    b = counts.blank_counts(df).first()
    assert (n.row_count, n.null_count, n.non_null_count) == (5, 1, 4)
    assert (b.empty_string_count, b.whitespace_only_count, b.padded_count) == (1, 1, 1)


def test_nan_is_null_and_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (-0.0,), (None,)], "x double")
    r = counts.distinct_counts(df).first()
    assert (r.non_null_count, r.distinct_count) == (2, 1)


def test_unicode_whitespace_is_stripped_like_python(spark):
    texts = [f"{w}x{w}" for w in WHITESPACE]
    assert all(t.strip() == "x" for t in texts)
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert counts.blank_counts(df).first().padded_count == len(texts)


def test_distinctness_of_big_integers_and_nested_values(spark):
    df = spark.createDataFrame(
        [(2**53, [1, 2]), (2**53 + 1, [1, 2]), (2**53 + 1, [2])], "k long, a array<int>"
    )
    got = rows(counts.distinct_counts(df), "column_name")
    assert got["k"].distinct_count == 2 and got["a"].distinct_count == 2


@pytest.mark.parametrize("partitions", ["2", "7", "64"])
def test_quantiles_equal_pandas_whatever_the_ranges(spark, partitions):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=700).round(2), np.full(400, 1.5), [1e9, -1e9]])
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": np.arange(len(values)) * 1.0}))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        q = rows(numeric.numeric_quantiles(df), "column_name")
        mad = rows(numeric.numeric_mad(df), "column_name")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    s = pd.Series(values)
    for p, name in numeric.QUANTILES.items():
        assert math.isclose(q["x"][name], s.quantile(p), rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(q["y"][name], (len(values) - 1) * p, rel_tol=1e-12, abs_tol=1e-9)
    assert math.isclose(mad["x"].mad, (s - s.median()).abs().median(), abs_tol=1e-12)


def test_moments_equal_pandas(spark):
    values = pd.Series([1.5, 2.25, 2.25, -4.0, 100.125, 0.0])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    m = numeric.moments(df).first()
    assert math.isclose(m.skewness, values.skew()) and math.isclose(m["std"], values.std())
    assert (m.zero_count, m.negative_count, m.positive_count) == (1, 1, 4)
    assert m.max_decimal_places == 3 and m.integer_valued is False


def test_integer_sequences(spark):
    df = spark.createDataFrame(
        [(i, i * 5, i % 3, float(i) + 0.5, i * i) for i in range(20)],
        "one int, five int, repeats int, half double, squares int",
    )
    got = rows(numeric.integer_sequences(df), "column_name")
    assert got["one"].dense and got["one"].counter_like
    assert got["five"].counter_like and not got["five"].step_one
    assert got["repeats"].step_one and not got["repeats"].counter_like
    assert not got["half"].counter_like and not got["squares"].counter_like


def test_text_shapes_regex_and_display(spark):
    df = spark.createDataFrame([(f"AB-{i:04d}",) for i in range(30)] + [("x",)], "code string")
    r = text.shape_descriptions(df).first()
    assert r.dominant_shape == "AA-9999" and r.collapsed_shape == "A{2}-9{4}"
    assert r.display_shape == "[A-Z]{2}-[0-9]{4}"
    import re

    assert r.is_regular and all(re.fullmatch(r.suggested_regex, f"AB-{i:04d}") for i in range(30))


def test_disguised_missing_and_variants(spark):
    values = ["N/A", "n/a ", "Paris", "PARIS", " paris", "Rome", None, "unknown"] + ["Oslo"] * 5
    df = spark.createDataFrame([(v,) for v in values], "city string")
    found = rows(text.disguised_missing(df), "token")
    assert found["n/a"]["count"] == 2 and found["unknown"]["count"] == 1
    v = text.case_variants(df).first()
    assert v.case_variant_groups == 2
    most = spark.createDataFrame([("unknown",)] * 5 + [("x",)] * 4, "c string")
    assert text.disguised_missing(most).count() == 0


def test_date_detection_and_ambiguity(spark):
    df = spark.createDataFrame(
        [("2024-04-30", "13/01/2024", "01/02/2024", "x"), ("2024-04-31", "05/06/2024", "03/04/2024", "y")]
        + [("2024-05-01 10:00", "01/01/2024", "05/06/2024", "2024-01-01")] * 40,
        "iso string, day_first string, unclear string, text string",
    )
    got = rows(dates.detect_dates(df), "column_name")
    assert got["day_first"].detected_format == "%d/%m/%Y" and not got["day_first"].format_ambiguous
    assert got["unclear"].detected_format == "%m/%d/%Y" and got["unclear"].format_ambiguous
    assert "text" not in got
    full = rows(dates.date_profile(df, "2024-04-30 12:00:00"), "column_name")
    assert "iso" not in full  # two of three distinct values parse: under 95%
    assert full["day_first"]["count"] == 42


def test_dates_in_one_format_with_time(spark):
    df = spark.createDataFrame(
        [(f"2024-01-{d:02d} 08:15:00",) for d in range(1, 31)], "at string")
    r = dates.date_profile(df, "2024-01-20").first()
    assert r.has_time_component and r.span_days == 29.0 and r.distinct_dates == 30


def test_monotonic_across_ranges(spark):
    n = 500
    data = [(i, i // 3, -i, (i * 37) % n) for i in range(n)]
    df = spark.createDataFrame(data, "k int, up int, down int, mixed int").repartition(5)
    assert dates.monotonic(df, "up", "k").first()[1:] == (True, False)
    assert dates.monotonic(df, "down", "k").first()[1:] == (False, True)
    assert dates.monotonic(df, "mixed", "k").first()[1:] == (False, False)


def brute_coverage(pairs):
    groups = defaultdict(list)
    for a, b in pairs:
        if a is not None and b is not None:
            groups[a].append(b)
    n = sum(map(len, groups.values()))
    bad = sum(len(g) for g in groups.values() if len(set(g)) > 1)
    return 100.0 * (1 - bad / n)


@pytest.mark.parametrize("seed", range(4))
def test_dependency_coverage_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    pairs = [
        (rnd.choice([None, *map(str, range(rnd.randint(2, 9)))]), str(rnd.randint(1, 3)))
        for _ in range(rnd.randint(40, 150))
    ]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = rows(tables.dependency_coverage(df, ["a", "b"]), "determinant")
    assert math.isclose(got["a"].coverage_percentage, brute_coverage(pairs), abs_tol=1e-9)
    assert math.isclose(
        got["b"].coverage_percentage, brute_coverage([(b, a) for a, b in pairs]), abs_tol=1e-9)


def test_prescreen_never_drops_a_holding_dependency(spark):
    df = spark.createDataFrame(
        [(i % 40, (i % 40) // 4, i % 7, None if i % 5 == 0 else (i % 40) * 2) for i in range(4000)],
        "a int, b int, c int, d int",
    )
    kept = tables.plausible_dependencies(df, ["a", "b", "c", "d"])
    assert {"b", "d"} <= set(kept["a"]) and "a" in kept["d"]
    found = rows(tables.functional_dependencies(df, ["a", "b", "c", "d"]), "determinant", "dependent")
    assert ("a", "b") in found and ("a", "d") in found and ("c", "a") not in found


def sales(spark):
    data = []
    for i in range(600):
        order, line = i // 4, i % 4 + 1
        data.append((
            f"SO{order:05d}", line, line % 2 + order % 2 * 2 + 1, order % 80 + 1, order % 6 + 1, i % 3 + 1,
            f"2024-{order % 12 + 1:02d}-{order % 28 + 1:02d}",
            f"2024-{order % 12 + 1:02d}-{(order + 3) % 28 + 1:02d}",
        ))
    return spark.createDataFrame(
        data, "OrderNumber string, OrderLineItem int, ProductKey int, CustomerKey int, "
        "TerritoryKey int, OrderQuantity int, OrderDate string, ShipDate string")


def test_sales_lines_profile(spark):
    p = profile_table(sales(spark), "sales", "2024-06-01")
    keys = [tuple(r["columns"]) for r in p.composites.collect()]
    assert ("OrderNumber", "OrderLineItem") in keys
    fds = rows(p.dependencies, "determinant", "dependent")
    assert ("OrderNumber", "CustomerKey") in fds
    columns = rows(p.columns, "column_name")
    assert columns["ProductKey"].code_like and columns["CustomerKey"].code_like
    assert columns["OrderDate"].datetime.detected_format == "%Y-%m-%d"
    codes = {r.code for r in p.observations.collect()}
    assert {"code_like_numeric", "date_format_detected", "regular_pattern"} <= codes


def test_profile_edge_cases(spark):
    empty = column_profile(spark.createDataFrame([], "a int, b string"), "2024-01-01").collect()
    assert [r.row_count for r in empty] == [0, 0]
    df = spark.createDataFrame(
        [(None, True, [1], "x" * 300), (None, False, [1], "y" * 300)],
        "nothing double, flag boolean, items array<int>, note string")
    got = rows(column_profile(df, "2024-01-01"), "column_name")
    assert got["nothing"].distinct_count == 0 and got["nothing"].null_percentage == 100.0
    assert got["items"].stored_as == "other" and got["items"].constant
    assert got["note"].free_text and got["note"].distinct_count == 2


def test_duplicate_rows_and_completeness(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "a"), (2, None), (None, None)], "k int, v string")
    d = tables.duplicate_rows(df).first()
    assert (d.complete_duplicate_rows, d.complete_duplicate_excess_count) == (3, 2)
    c = tables.row_completeness(df).first()
    assert (c.fully_complete_rows, c.rows_with_any_null) == (3, 2)
    assert c.average_filled_percentage_per_row == pytest.approx(70.0)
    assert tables.co_missing_patterns(df).first()["columns"] == ["k", "v"]


def test_reduction_drops_inferable_dependency(spark):
    pairs = spark.createDataFrame(
        [("a", "b", 100.0), ("b", "c", 100.0), ("a", "c", 100.0), ("c", "d", 99.0)],
        "determinant string, dependent string, coverage_percentage double")
    kept = {(r.determinant, r.dependent) for r in tables.reduce_dependencies(pairs).collect()}
    assert kept == {("a", "b"), ("b", "c"), ("c", "d")}


def ks(a, b):
    points = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in points)


@pytest.mark.parametrize("seed", range(3))
def test_ks_and_psi_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    a = [rnd.randint(0, 30) / 2 for _ in range(200)]
    b = [rnd.randint(5, 45) / 2 for _ in range(150)]
    ca, cb = [rnd.choice("xyz") for _ in a], [rnd.choice("xyw") for _ in b]
    left = spark.createDataFrame(list(zip(a, ca)), "n double, c string")
    right = spark.createDataFrame(list(zip(b, cb)), "n double, c string")
    got = rows(drift.column_drift(left, right), "column_name")
    assert got["n"].statistic == round(ks(a, b), 4)
    values = set(ca) | set(cb)
    e = np.array([ca.count(v) / len(ca) for v in values]) + 1e-6
    k = np.array([cb.count(v) / len(cb) for v in values]) + 1e-6
    e, k = e / e.sum(), k / k.sum()
    assert got["c"].statistic == round(float(((k - e) * np.log(k / e)).sum()), 4)


def test_small_samples_are_not_drift(spark):
    left = spark.createDataFrame([(float(i), None) for i in range(29)], "n double, m double")
    right = spark.createDataFrame([(float(i), None) for i in range(99)], "n double, m double")
    got = rows(drift.column_drift(left, right), "column_name")
    assert {r.status for r in got.values()} == {"insufficient_sample"} and len(got) == 2


def test_ranges_do_not_change_the_answer(spark):
    df = spark.createDataFrame([(0, float(i % 11), 1) for i in range(300)], "g int, v double, cnt long")
    q = ranks.exact_quantiles(df, ["g"], [0.0, 0.33, 1.0])
    got = {round(r.p, 2): r.q for r in q.collect()}
    s = pd.Series([float(i % 11) for i in range(300)])
    assert got == {0.0: 0.0, 0.33: s.quantile(0.33), 1.0: 10.0}
