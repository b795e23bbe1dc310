"""Steps whose cost or result once depended on the size of the table."""

import threading

import numpy as np
from pyspark.sql import functions as F

from dqloom.catalog import meaning_queries
from dqloom.operators import combinations, relationships, tables, text
from dqloom.operators.frequency import numeric_values, value_frequencies
from dqloom.operators.ranks import exact_quantiles, with_ranges


def test_quantiles_are_exact_beyond_the_sketch(spark):
    """Sketches of many values differ from one evaluation to the next: all steps must read
    the same cut points."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        n = 600_001
        table = spark.range(n).select((F.col("id") * 7919 % n).alias("a"), (F.col("id") % 200_001).alias("b"))
        counted = value_frequencies(table).persist()
        found = exact_quantiles(numeric_values(counted), ["pos"], [0.25, 0.5, 0.75]).collect()
        counted.unpersist()
        assert {(r.pos, r.p): r.q for r in found} == {
            (0, 0.25): 150_000, (0, 0.5): 300_000, (0, 0.75): 450_000, (1, 0.25): 50_000, (1, 0.5): 100_000, (1, 0.75): 150_000}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_are_in_order_and_whole(spark):
    values = spark.range(1000).select(F.lit(0).alias("pos"), (F.col("id") % 250).cast("double").alias("v"), F.lit(1).alias("cnt"))
    ranged = with_ranges(values, ["pos"], "v", "cnt", fixed=True)
    edges = [(r.lo, r.hi, r.n) for r in ranged.groupBy("rng").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).orderBy("rng").collect()]
    assert sum(n for _, _, n in edges) == 1000
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))


def test_shapes_read_values_once_and_keep_case_and_digits(spark):
    rows = [(0, "Ab-1", 2), (0, "xY-2", 1), (0, "AB-\u0663", 1), (0, "q", 3), (1, "12", 1), (1, "34", 4)]
    values = spark.createDataFrame(rows, "pos int, value string, cnt long")
    found = {r.pos: r for r in text.shape_details(values).collect()}
    assert (found[0].dominant_shape, found[0].display_shape, round(found[0].dominant_coverage_percentage, 4)) == (
        "AA-9", "[A-Za-z]{2}-[0-9]", 57.1429)
    assert (found[1].dominant_shape, found[1].suggested_regex, found[1].constant_length) == ("99", r"^(?:\d){2}$", True)
    plan = text.separator_summary(values)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan
    separators = {(r.pos, r.separator): r["count"] for r in text.separator_summary(values).collect()}
    assert separators == {(0, "-"): 4, (0, "\u0663"): 1}


def test_composite_hashes_travel_with_their_combination(spark):
    df = spark.range(300).select((F.col("id") % 20).alias("a"), (F.col("id") % 15).cast("string").alias("b"),
                                 F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("c"))
    combos = [("a", "b"), ("b", "c"), ("a", "b", "c"), ("a", "c")]
    found = tables.composite_uniqueness(df, combos)
    assert "hashpartitioning(a#" in found._jdf.queryExecution().executedPlan().toString()
    rows = [r.asDict() for r in df.collect()]
    for r in found.collect():
        whole = [t for x in rows if None not in (t := tuple(x[c] for c in r["columns"]))]
        assert (r.evaluated_row_count, r.composite_distinct_count) == (len(whole), len(set(whole)))
        assert r.duplicate_composite_rows == sum(whole.count(t) for t in set(whole) if whole.count(t) > 1)
    assert found.count() == len(combos)


def test_combinations_travel_packed_and_are_counted_exactly(spark):
    """one row per range of hashes in the shuffle, whatever the number of rows."""
    n = 60_000
    df = spark.range(n).select((F.col("id") % 25_000).alias("a"), F.when(F.col("id") % 10 > 0, F.lit("x")).alias("b"), "id")
    found = combinations.combination_counts(df, [[F.col("a")], [F.col("b")], [F.col("a"), F.col("b")], [F.lit(None).cast("int")]], 700_000)
    assert "partial_count" not in found._jdf.queryExecution().executedPlan().toString()
    # Of ids 0 to 59,999, a holds 0 to 9,999 three times and the rest twice; b is null at every tenth.
    assert {r.combo: (r.rows, r.distinct, r.repeated) for r in found.collect()} == {
        0: (n, 25_000, n), 1: (54_000, 1, 54_000), 2: (54_000, 22_500, 54_000)}


def test_packed_hashes_come_back_and_ties_are_told_apart():
    a = np.array([5, 1, 5, 2**64 - 1, 5], np.uint64)
    b = np.array([2, 9, 1, 0, 2], np.uint64)
    a, b, counts = combinations.folded(a, b, np.ones(5, np.uint64))
    assert list(zip(a.tolist(), b.tolist(), counts.tolist())) == [(1, 9, 1), (5, 1, 1), (5, 2, 2), (2**64 - 1, 0, 1)]
    for numbers in (a, b, np.zeros(3, np.uint64)):
        data = combinations.packed(numbers)
        assert combinations.unpacked(data, len(numbers)).tolist() == numbers.tolist()
    assert len(combinations.packed(np.zeros(3, np.uint64))) == 1


def test_key_profile_counts_columns_without_aggregating_rows(spark):
    """the same facts from packed hashes and one scan."""
    df = spark.range(50).select(
        F.col("id").alias("k"), (F.col("id") * 3).alias("threes"), F.when(F.col("id") > 0, F.col("id") * F.col("id")).alias("squares"),
        (F.col("id") / 4).alias("quarters"), F.when(F.col("id") == 7, float("nan")).otherwise(F.col("id").cast("double")).alias("gap"),
        (F.col("id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("none"), (F.col("id") - 1).alias("below"),
        F.when(F.col("id") == 0, float("inf")).otherwise(F.col("id").cast("double")).alias("endless"))
    other = spark.createDataFrame([("a", 1), ("a", None)], "t string, x int")
    found = {(r.table_name, r.column_name): r for r in relationships.key_profile({"n": df, "o": other}).collect()}
    got = {c: (found["n", c].distinct_count, found["n", c].non_null_count, found["n", c].counter_like, found["n", c].float_measure) for c in df.columns}
    assert got == {"k": (50, 50, True, False), "threes": (50, 50, True, False), "squares": (49, 49, False, False),
                   "quarters": (50, 50, False, True), "gap": (49, 49, False, False), "even": (2, 50, False, False),
                   "none": (0, 0, False, False), "below": (50, 50, False, False), "endless": (50, 50, False, False)}
    assert (found["o", "t"].distinct_count, found["o", "x"].non_null_count, found["o", "x"].row_count) == (1, 1, 2)


def test_narrow_columns_take_one_hash(spark):
    df = spark.range(10_000).select((F.col("id") % 4_000 - 7).alias("a"), (F.col("id") % 3 / 7).alias("b"))
    found = combinations.combination_counts(df, [[F.col("a")], [F.col("b")], [F.col("a"), F.col("b")]], 10_000, [0, 1])
    assert "b0" not in found._jdf.queryExecution().analyzed().toString()
    assert {r.combo: (r.rows, r.distinct, r.repeated) for r in found.collect()} == {
        0: (10_000, 4_000, 10_000), 1: (10_000, 3, 10_000), 2: (10_000, 10_000, 0)}


def test_profiles_of_two_tables_are_evaluated_at_the_same_time(spark, sf, monkeypatch):
    both = threading.Barrier(2, timeout=60)

    def profile(df, as_of):
        both.wait()
        return spark.createDataFrame([(c,) for c in df.columns], "column_name string")

    monkeypatch.setattr(meaning_queries, "column_profile", profile)
    monkeypatch.setattr(meaning_queries, "_PROFILES", {})
    found = {(r.table_name, r.column_name) for r in meaning_queries.profiles(spark, sf).collect()}
    assert len(found) == 16 and {("customer", "c_email"), ("events", "props")} <= found


def test_training_examples_evaluate_the_evidence_once(spark, sf, monkeypatch):
    asked, evidence = [], meaning_queries._evidence
    monkeypatch.setattr(meaning_queries, "_evidence", lambda *a: asked.append(a) or evidence(*a))
    rows = meaning_queries.training_examples(spark, sf).collect()
    assert len(asked) == 1 and len(rows) == len({(r.table_name, r.column_name) for r in rows}) > 0
    feedback, predicted = meaning_queries._feedback(evidence(spark, sf))
    plain = meaning_queries.learning.training_examples(feedback, predicted, evidence(spark, sf))
    assert sorted(map(str, rows)) == sorted(map(str, plain.collect()))
