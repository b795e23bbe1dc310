"""No report limit, size switch or rare value may change an answer."""

import pytest
from pyspark.sql import functions as F

from dqloom.functions import dates
from dqloom.functions.missing import canonical_key
from dqloom.operators import counts, meaning, rca, tables
from dqloom.operators.dates import monotonic
from dqloom.operators.rules import Context
from dqloom.plans import profile, quality
from dqloom.plans.observations import observations
from dqloom.sources import files, versions


def results(spark, rules, **frames):
    out = quality.run_rules(spark, rules, Context(as_of="2024-06-01", tables=frames))
    return {r.rule_id: (r.failed_rows, r.status) for r in out.collect()}


def test_broken_dependency_beside_many_exact_ones(spark):
    columns = [(F.col("id") % 60).alias("a")] + [((F.col("id") % 60) * (i + 2)).alias(f"b{i}") for i in range(6)]
    df = spark.range(600).select(*columns, F.when(F.col("id") == 599, 99).otherwise(F.col("id") % 60 % 5).alias("broken"))
    p = profile.profile_table(df, "t", "2024-06-01")
    assert p.dependencies.filter("coverage_percentage < 100").count() > 0
    assert p.observations.filter("code = 'dependency_violations'").count() == 1


def test_dependency_columns_have_no_limit():
    facts = [{"column_name": f"c{i:02}", "distinct_count": 5, "non_null_count": 100, "is_constant": False,
              "is_free_text": False, "is_float_measure": False} for i in range(45)]
    assert len(profile.dependency_columns(facts)) == 45


def test_all_findings_are_told(spark):
    df = spark.range(20).select(*[F.lit(f"v{i}").alias(f"k{i}") for i in range(70)])
    columns = profile.column_profile(df, "2024-06-01")
    p = [tables.duplicate_rows(df), tables.row_completeness(df), tables.composite_candidates(df, [], 20),
         spark.createDataFrame([], tables.FD_SCHEMA)]
    assert observations(columns, *p).filter("code = 'constant_column'").count() == 70
    assert observations(columns, *p, limit=3).count() == 3


def test_root_causes_look_at_every_column(spark):
    df = spark.range(50).select("id", *[F.concat(F.lit("x"), F.col("id") % (i + 2)).alias(f"t{i:02}") for i in range(12)])
    rule = {"rule_id": "r", "table": "t", "column": "id", "rule_template": "NUMERIC_RANGE", "parameters": {"max": 20}}
    found = rca.analyze_failures([rule], Context(as_of="2024-06-01", tables={"t": df}))
    assert found.filter("view = 'concentration'").select("column_name").distinct().count() == 12


@pytest.mark.parametrize("size", [3, 199, 201])
def test_lookup_lists_agree_whatever_their_size(spark, size):
    df = spark.createDataFrame([("red apple",), ("stone",)], "v string")
    for entries, failed in (([f"e{i}_" for i in range(size - 1)] + ["apple"], 1), ([f"e{i}_" for i in range(size - 1)] + [""], 0)):
        rule = {"rule_id": "r", "table": "t", "column": "v", "rule_template": "REFERENCE_LOOKUP",
                "parameters": {"reference_values": entries, "match_mode": "contains"}}
        assert results(spark, [rule], t=df) == {"r": (failed, "passed")}


def test_listed_values_are_complete_or_absent(spark):
    df = spark.range(200).select((F.col("id") % 20).cast("string").alias("few"), (F.col("id") % 40).cast("string").alias("many"))
    got = {r.column_name: r.category_values for r in profile.column_profile(df, "2024-06-01").collect()}
    assert sorted(got["few"]) == sorted(map(str, range(20))) and got["many"] is None


def test_long_texts_are_told_whole(spark):
    long = "x" * 300
    df = spark.range(40).select(F.lit(long).alias("one"), F.when(F.col("id") % 2 == 0, long + "y").otherwise("short").alias("two"))
    assert {r.column_name: r.representative_value for r in counts.constant_columns(df).collect()}["one"] == long
    assert {r.value for r in counts.top_values(df, ["two"]).collect()} == {long + "y", "short"}
    got = {r.column_name: r for r in profile.column_profile(df, "2024-06-01").collect()}
    assert got["one"].representative_value == long
    assert {v.value for v in got["two"].top_values} == {long + "y", "short"} and sorted(got["two"].category_values) == ["short", long + "y"]


def test_long_ids_stay_exact(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("a,b,c\n1234567890123456789,12345678901234567890123,1\n1234567890123456788,2," + "9" * 45 + "\n")
    got = files.typed(files.read_text_table(spark, str(path)))
    assert [t for _, t in got.dtypes] == ["bigint", "decimal(38,0)", "string"]
    assert [r.a for r in got.collect()] == [1234567890123456789, 1234567890123456788]


def test_encoding_is_decided_by_bytes(spark, tmp_path):
    for name, data, expected in (("u", "é,x\nCafé �,€\n".encode(), ("é", "Café �", "€")),
                                 ("b", b"\xef\xbb\xbfa,x\nb,c\n", ("a", "b", "c")),
                                 ("w", "é,x\nCafé,€\n".encode("cp1252"), ("é", "Café", "€"))):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(data)
        df = files.read_text_table(spark, str(path))
        assert (df.columns[0], *df.first()) == expected


def test_fraction_and_offset_formats(spark):
    df = spark.createDataFrame([("2024-01-05 10:00:00.5",), ("2024-01-05 10:00:00.123456",), ("2024-01-05 10:00:00.",)], "v string")
    parsed = [r[0] for r in df.select(dates.parse_format(F.col("v"), "%Y-%m-%d %H:%M:%S.%f")).collect()]
    assert [p is not None for p in parsed] == [True, True, False] and parsed[0].microsecond == 500_000
    df = spark.createDataFrame([("2024-01-05 10:00:00 +0100",), ("2024-01-05 10:00:00 +01:00",), ("2024-01-05 10:00:00",)], "v string")
    parsed = [r[0] for r in df.select(dates.parse_format(F.col("v"), "%Y-%m-%d %H:%M:%S %z")).collect()]
    assert [p and p.hour for p in parsed] == [9, 9, None]


def test_keys_of_doubles_are_plain_digits(spark):
    df = spark.createDataFrame([(10000000.5,), (0.00025,), (1.5,), (3.0,)], "v double")
    assert [r[0] for r in df.select(canonical_key(F.col("v"), df.schema["v"].dataType)).collect()] == ["10000000.5", "0.00025", "1.5", "3"]


def test_a_rule_failing_on_a_value_leaves_the_others(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    bad = df.withColumn("broken", F.when(F.col("id") == 2, F.raise_error(F.lit("no such value")).cast("string")).otherwise("x"))
    rules = [{"rule_id": "ok", "table": "t", "column": "v", "rule_template": "NOT_NULL"},
             {"rule_id": "bad", "table": "t", "column": "broken", "rule_template": "NOT_NULL"}]
    got = results(spark, rules, t=bad)
    assert got["ok"] == (1, "passed") and got["bad"][1] == "error"


def test_a_failed_write_does_not_block_a_dataset(spark, tmp_path):
    good = spark.range(3)
    broken = good.select(F.raise_error(F.lit("stop")).cast("string").alias("x"))
    with pytest.raises(Exception, match="stop"):
        versions.write_version(spark, str(tmp_path), "d", {"good": good, "broken": broken})
    number = versions.write_version(spark, str(tmp_path), "d", {"good": good})
    assert versions.read_version(spark, str(tmp_path), "d", number, "good").count() == 3
    assert [r.version_number for r in versions.versions(spark, str(tmp_path)).collect()] == [number]


def test_monotonic_along_text(spark):
    df = spark.range(100).select(F.format_string("k%03d", "id").alias("o"), "id", (F.col("id") % 7).alias("m"))
    assert [tuple(monotonic(df, c, "o").first()[1:]) for c in ("id", "m")] == [(True, False), (False, False)]


def test_tied_concepts_go_by_id(spark):
    concepts = spark.createDataFrame([(f"c{i}", [1.0, 0.0]) for i in range(9, -1, -1)] + [("z", [0.0, 1.0])], "concept_id string, vector array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "id long, vector array<double>")
    for rows in (100, 3):
        got = meaning.vector_topk(queries, concepts, 3, block_rows=rows).orderBy("position").collect()
        assert [r.concept_id for r in got] == ["c0", "c1", "c2"]
