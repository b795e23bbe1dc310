"""Inclusion discovery: bitmaps of places against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from dqloom import catalog
from dqloom.operators import inclusion, relationships


def lake(spark, wide=75, seed=1):
    """Three tables, one of them with more columns than a word has bits."""
    rng = random.Random(seed)
    def cell(c):
        return None if rng.random() < 0.1 else rng.randrange(3 + c % 9) * (1 + c % 3)
    first = [tuple(cell(c) for c in range(wide)) for _ in range(60)]
    second = [(str(rng.randrange(30)), float(rng.randrange(20)), "x" * 200 if i % 2 else " 5 ") for i in range(50)]
    return {
        "wide": spark.createDataFrame(first, ", ".join(f"c{i} int" for i in range(wide))),
        "typed": spark.createDataFrame(second, "a string, b double, c string"),
        "flags": spark.createDataFrame([(True, None), (False, None)], "f boolean, n string"),
    }, {"wide": first, "typed": second}


def text(v):
    if isinstance(v, float) and v == int(v):
        v = int(v)
    return None if v is None else str(v).strip()


def test_shared_counts_equal_plain_sets(spark):
    tables, raw = lake(spark)
    keys = inclusion.value_bitmaps(tables)
    sets = {}
    for i, (t, c) in enumerate(keys.places):
        if t == "flags":
            sets[i] = {"0", "1"} if c == "f" else set()
        else:
            at = tables[t].columns.index(c)
            sets[i] = {text(r[at]) for r in raw[t]} - {None}
    got = {(r.parent, r.child): r.shared for r in inclusion.shared_counts(keys).collect()}
    wanted = {(p, c): len(a & b) for p, a in sets.items() for c, b in sets.items() if p != c and a & b}
    wanted |= {(inclusion.EVERY, p): len(a) for p, a in sets.items() if a}
    assert len(keys.places) > inclusion.WORD and got == wanted
    some = {(r.parent, r.child): r.shared for r in inclusion.shared_counts(keys, [0, 63, 64, 76], min_shared=4).collect()}
    assert some == {k: n for k, n in wanted.items() if k[0] in (inclusion.EVERY, 0, 63, 64, 76) and n >= 4}


def test_masks_fill_words_to_the_sign_bit():
    assert inclusion.masks([0, 1, 63, 64, 130], 3) == [3 - (1 << 63), 1, 4]


def test_number_ranges(spark):
    tables, _ = lake(spark)
    keys = inclusion.value_bitmaps(tables)
    got = {keys.places[r.place]: (r.lo, r.hi, r.numeric) for r in inclusion.number_ranges(keys).collect()}
    assert got[("typed", "b")][2] and not got[("typed", "c")][2] and not got[("flags", "n")][2]
    assert got[("wide", "c0")] == (0.0, 2.0, True)


def test_pairs_come_from_values_and_words_and_lose_no_candidate(spark):
    """The pairs left out could not have been candidates."""
    tables, _ = lake(spark, wide=6)
    tables["customer"] = spark.createDataFrame([(i,) for i in range(40)], "customer_id int")
    tables["visit"] = spark.createDataFrame([(i + 1000, i % 35) for i in range(90)], "visit_id int, customer_ref int")
    profile = relationships.key_profile(tables)
    keys = relationships.key_values(tables)
    shared = relationships.shared_values(keys)
    sizes = shared.filter("parent_table IS NULL").select(
        F.col("child_table").alias("table_name"), F.col("child_column").alias("column_name"), F.col("contained_distinct").alias("distinct"))
    shared = shared.filter("parent_table IS NOT NULL")
    every = [(a, b, c, d) for a, b in keys.places for c, d in keys.places if a != c]
    crossed = spark.createDataFrame(every, "child_table string, child_column string, parent_table string, parent_column string")
    plain = relationships.score_pairs(
        relationships.column_pairs(profile, crossed), shared, relationships.dense_integers(keys, sizes))
    wanted = relationships.fk_candidates(plain).drop("position").collect()
    got = relationships.discover(tables).drop("position").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, wanted), key=repr) and got


@pytest.mark.parametrize("link", [("lineitem.l_orderkey", "orders.o_orderkey"), ("lineitem.l_partkey", "part.p_partkey"),
                                  ("lineitem.l_suppkey", "supplier.s_suppkey"), ("supplier.s_nationkey", "nation.n_nationkey"),
                                  ("orders.o_custkey", "customer.c_custkey"), ("labels.doc_id", "documents.doc_id")])
def test_known_links_are_found(spark, sf, link, found=[]):  # noqa: B006
    if not found:
        found += catalog.queries()["fk_candidates"](spark, sf).collect()
    assert any((f"{r.child_table}.{r.child_column}", f"{r.parent_table}.{r.parent_column}") == link and r.position == 1 for r in found)
