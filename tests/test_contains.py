"""Contained reference values and sketched cut points."""

import random

import pytest
from pyspark.sql import functions as F

from dqloom.operators import ranks, setrules
from dqloom.operators.rules import Context
from dqloom.plans.quality import failing_rows, rule_counts, run_rules

RULE = {"rule_id": "c", "table": "t", "column": "v", "metric": "validity", "rule_template": "REFERENCE_LOOKUP",
        "parameters": {"reference": "list", "match_mode": "contains"}}


def texts(n=300, seed=2):
    rng = random.Random(seed)
    stem = "the same long beginning of more than thirty-two characters "
    entries = [stem + str(i) for i in range(60)] + ["é", "zz", "needle in", "漢字", "x" * 90]
    pieces = [*entries, "hay ", "stack", stem, "e", "x" * 40, " "]
    return entries, [None, *["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4))) for _ in range(n)]] * 2


@pytest.mark.parametrize("characters", [10_000_000, 400, 60])
def test_contains_is_the_same_with_one_and_many_automata(spark, monkeypatch, characters):
    monkeypatch.setattr(setrules, "SHARD_CHARACTERS", characters)
    entries, values = texts()
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    ctx = Context(tables={"t": df}, references={"list": spark.createDataFrame([(e,) for e in [*entries, entries[0], None]], "e string")})
    wanted = sum(v is not None and not any(e in v.strip() for e in entries) for v in values if (v or "").strip())
    counts = rule_counts(df, RULE, ctx).first()
    assert counts.failed_rows == wanted and 0 < wanted < len(values)
    assert failing_rows(df, RULE, ctx).count() == wanted


@pytest.mark.parametrize(("entries", "failed"), [([], 2), ([""], 0), (["a", ""], 0), (["b"], 1)])
def test_contains_of_few_entries(spark, entries, failed):
    df = spark.createDataFrame([("abc",), ("xyz",), (None,)], "v string")
    ctx = Context(tables={"t": df}, references={"list": spark.createDataFrame([(e,) for e in entries], "e string")})
    assert rule_counts(df, RULE, ctx).first().failed_rows == failed


def test_fused_set_rules_equal_single_ones(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), rng.choice(["a", "A ", "b", None, ""]), float(rng.randrange(4)), rng.choice([1, 2, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, s string, x double, p int").repartition(3)
    parents = spark.createDataFrame([(1,), (5,), (7,)], "id int")
    ctx = Context(tables={"t": df, "parents": parents}, references={})
    make = lambda i, template, **more: {"rule_id": f"r{i}", "table": "t", "metric": "validity", "rule_template": template, **more}
    rules = [
        make(0, "UNIQUE", column="k"), make(1, "COMPOSITE_UNIQUE", columns=["s", "x"]),
        make(2, "COMPOSITE_UNIQUE", columns=["s", "p"], parameters={"ignore_nulls": False}),
        make(3, "FUNCTIONAL_DEPENDENCY", parameters={"determinant_column": "k", "dependent_column": "s"}),
        make(4, "FUNCTIONAL_DEPENDENCY", parameters={"determinant_column": "x", "dependent_column": "p"}),
        make(5, "FOREIGN_KEY_EXISTS", parameters={"child_column": "k", "parent_table": "parents", "parent_column": "id"}),
        make(6, "REFERENCE_LOOKUP", column="s", parameters={"reference_values": ["a", "b"]}),
        make(7, "REFERENCE_HIERARCHY", parameters={"parent_column": "s", "child_column": "p", "hierarchy": {"a": ["1"], "b": ["2"]}}),
        make(8, "FOREIGN_KEY_EXISTS", parameters={"child_column": "k", "parent_table": "absent", "parent_column": "id"}),
    ]
    fused = {r.rule_id: (r.status, r.total_rows, r.applicable_rows, r.failed_rows) for r in run_rules(spark, rules, ctx).collect()}
    for rule in rules[:8]:
        one = setrules.set_rule(df, rule, ctx).counts().first()
        assert fused[rule["rule_id"]] == ("passed", one.total_rows, one.applicable_rows, one.failed_rows), rule
        assert one.failed_rows == failing_rows(df, rule, ctx).count()
    assert fused["r8"][0] == "error"


def test_cut_points_of_weighted_groups(spark):
    values = spark.range(0, 20_000, 1, 8).select(
        (F.col("id") % 3).cast("int").alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"), F.lit(1).alias("w"))
    values = values.unionByName(spark.createDataFrame([(9, 5.0, 0), (9, 7.0, 0)], "g int, v double, w int"))
    points = [i / 16 for i in range(1, 16)]
    got = {r.g: r.flat for r in ranks.cut_points(values, ["g"], "v", "w", points).collect()}
    assert got[9] is None
    for g in range(3):
        assert all(abs(x - p * 20_000) < 600 for x, p in zip(got[g], points, strict=True))
    exact = {(r.g, r.p): r.q for r in ranks.exact_quantiles(values.withColumnRenamed("w", "cnt"), ["g"], [0.25, 0.5]).collect()}
    for g in range(3):
        own = sorted(i * 7919 % 20_000 for i in range(g, 20_000, 3))
        h = (len(own) - 1) * 0.5
        assert exact[g, 0.5] == pytest.approx(own[int(h)] + (own[min(int(h) + 1, len(own) - 1)] - own[int(h)]) * (h - int(h)))
