"""Relationship discovery, column meaning, recommendation and learning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqloom.functions.similarity import split_name, text_similarity
from dqloom.operators import learning, meaning, recommend, relationships


def pair_score(spark, parent, child):
    tables = {
        "parents": spark.createDataFrame([(v,) for v in parent], "customer_id string"),
        "children": spark.createDataFrame([(v,) for v in child], "customer_id string"),
    }
    got = relationships.discover(tables).filter("parent_table = 'parents'").first()
    return got


def test_full_containment(spark):
    r = pair_score(spark, [f"C{i}" for i in range(1, 21)], [f"C{i}" for i in range(1, 16)])
    assert r.containment == 1.0 and r.orphan_distinct_count == 0 and r.score >= 0.7


def test_orphans_lower_but_keep_the_candidate(spark):
    r = pair_score(
        spark, [f"C{i}" for i in range(1, 21)],
        [f"C{i}" for i in range(1, 8)] + [f"X{i}" for i in range(8)])
    assert r.containment < 0.5 and r.orphan_distinct_count == 8 and r.score >= 0.4


def test_keys_compare_across_types(spark):
    tables = {
        "a": spark.createDataFrame([(1.0,), (2.5,)], "k double"),
        "b": spark.createDataFrame([("1",), (" 2.5",)], "k string"),
        "c": spark.createDataFrame([(True,), (False,)], "k boolean"),
    }
    got = {(r.child_table, r.parent_table): r.contained_distinct for r in
           relationships.containment(relationships.key_values(tables)).collect()}
    assert got[("a", "b")] == 2 and got[("c", "a")] == 1


def test_decisions_survive_a_rerun(spark):
    cols = "kind string, parent_table string, parent_column string, child_table string, child_column string"
    link = ("relationship", "p", "id", "c", "pid")
    fresh = spark.createDataFrame([(*link, 0.9), ("relationship", "p", "id", "d", "pid", 0.5)],
                                  cols + ", score double")
    old = spark.createDataFrame(
        [(*link, 0.7, "rejected"), ("relationship", "q", "id", "c", "x", 0.4, "manual"),
         ("relationship", "q", "id", "c", "y", 0.4, "pending")], cols + ", score double, status string")
    got = {(r.parent_table, r.child_table, r.child_column): (r.score, r.status)
           for r in relationships.merge_decisions(fresh, old).collect()}
    assert got == {("p", "c", "pid"): (0.9, "rejected"), ("p", "d", "pid"): (0.5, "pending"),
                   ("q", "c", "x"): (0.4, "manual")}


def test_name_splitting_and_similarity(spark):
    names = ["customerID", "IDNumber", "addr1", "order-line_no", "ABCd"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [" ".join(r[0]) for r in df.select(split_name(F.col("n"))).collect()]
    assert got == ["customer id", "id number", "addr 1", "order line no", "ab cd"]
    s = spark.createDataFrame([("customer_id", "CustomerKey")], "a string, b string").select(
        text_similarity(F.col("a"), F.col("b"))).first()[0]
    assert s == pytest.approx(
        0.6 * 0.5 + 0.4 * (1 - 3 / 12))


def test_name_parts(spark):
    df = spark.createDataFrame(
        [("customer", "customer_signup_date"), ("t", "is_fraud"), ("t", "x1"), ("t", "col_amount_num")],
        "table_name string, column_name string")
    got = {r.column_name: r for r in meaning.parse_names(df, "column_name", "table_name").collect()}
    assert got["customer_signup_date"]["key"] == "signup date"
    assert got["customer_signup_date"]["head"] == "date"
    assert got["customer_signup_date"].entities == ["signup"]
    assert got["is_fraud"].entities == ["fraud"] and got["x1"].opaque
    assert got["col_amount_num"]["key"] == "amount"


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_vector_topk_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(30, 8)), rng.normal(size=(11, 8))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id int, vector array<double>")
    concepts = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(c)], "concept_id int, vector array<double>")
    got = {(r.id, r.position): r.concept_id for r in
           meaning.vector_topk(queries, concepts, 3, block_rows).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(q) @ unit(c).T), axis=1)[:, :3]
    assert got == {(i, k + 1): best[i, k] for i in range(30) for k in range(3)}


def test_confidence_levels(spark):
    df = spark.createDataFrame(
        [(0.9, 0.8, 0.2, "KB_MATCH"), (0.9, 0.8, 0.06, "KB_MATCH"), (0.9, 0.8, 0.01, "KB_MATCH"),
         (0.9, 0.3, 0.5, "KB_MATCH"), (0.9, 1.0, 0.5, "FAMILY_MATCH"), (0.3, 1.0, 0.5, "UNKNOWN")],
        "s double, c double, m double, k string")
    got = [r[0] for r in df.select(meaning.confidence_level(*(F.col(x) for x in "scmk"))).collect()]
    assert got == ["Strong", "Probable", "Ambiguous", "Ambiguous", "Ambiguous", "Unknown"]


def test_reranker_needs_enough_examples_of_both_kinds(spark):
    few = spark.createDataFrame([(i, float(i), i % 2) for i in range(10)], "k int, x double, label int")
    assert learning.train_reranker(few, ["x"], "k").status == "insufficient_data"
    data = spark.createDataFrame(
        [(i, (1.0 if i % 2 else -1.0) + (i % 7) / 10, i % 2) for i in range(200)],
        "k int, x double, label int")
    out = learning.train_reranker(data, ["x"], "k")
    r = out.metrics.first()
    assert out.status == "trained" and r.accuracy == 1.0 and r.f1 == 1.0


def test_date_order_pairs(spark):
    df = spark.createDataFrame(
        [("t", 0, "start_at"), ("t", 1, "end_at"), ("t", 2, "created_on"), ("u", 0, "end_at")],
        "table_name string, pos int, column_name string",
    ).withColumn("stored_as", F.lit("datetime")).withColumn(
        "datetime", F.lit(None).cast("struct<a:int>"))
    got = [r.target_columns for r in recommend.date_order_candidates(df).collect()]
    assert got == [["start_at", "end_at"]]


def test_queries_and_oracles_are_registered():
    from dqloom import catalog

    queries, sql = catalog.queries(), catalog.oracles()
    assert len(queries) > 110 and set(sql) <= set(queries) and len(sql) > 80
