"""Key and dependency search on wide tables against plain counts."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from dqloom.operators import evidence, tables


def wide(spark, rows=2500, columns=60, seed=3):
    """Columns of 2 to a few hundred values, some tied to others, some with missing values."""
    random = np.random.default_rng(seed)
    data = {}
    for c in range(columns):
        values = random.integers(0, [2, 3, 5, 9, 14, 18][c % 6], rows).astype(float)
        if c % 7 == 3:
            values = data[f"c{c - 1}"] // 2
        if c % 11 == 5:
            values = np.where(random.random(rows) < 0.004, 999, data[f"c{c - 3}"] * 2)
        if c % 13 == 4:
            values = np.where(random.random(rows) < 0.2, np.nan, values)
        data[f"c{c}"] = values
    # A pair and a triple that are keys, nearly.
    data["c58"], data["c59"] = np.arange(rows) // 50.0, np.arange(rows) % 50.0
    data["c59"][:60] = 7.0
    data["c57"] = (np.arange(rows) // 3) % 50.0
    frame = pd.DataFrame(data).astype("Int64")
    frame = frame[[c for c in frame.columns if frame[c].nunique() > 1]]
    df = spark.createDataFrame([tuple(None if pd.isna(v) else int(v) for v in r) for r in frame.itertuples(index=False)],
                               ", ".join(f"{c} int" for c in frame.columns)).repartition(4).cache()
    return df, frame


def facts(frame):
    return [{"column_name": c, "distinct_count": int(frame[c].nunique()), "non_null_count": int(frame[c].notna().sum()), "is_constant": False,
             "is_float_measure": False, "is_free_text": False, "is_key_like": False} for c in frame.columns]


def jobs(spark, action):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    out = action()
    return out, len(set(tracker.getJobIdsForGroup()) - before)


def plain_keys(frame, row_count):
    codes = {c: frame[c].fillna(-1).to_numpy(np.int64) for c in frame.columns}
    there = {c: frame[c].notna().to_numpy() for c in frame.columns}
    distinct = {c: frame[c].nunique() for c in frame.columns}
    out, unique = {}, set()
    for size in (2, 3):
        for combo in itertools.combinations(frame.columns, size):
            if math.prod(distinct[c] for c in combo) < 0.5 * row_count or any(s in unique for s in itertools.combinations(combo, size - 1)):
                continue
            whole = np.logical_and.reduce([there[c] for c in combo])
            key = np.zeros(row_count, np.int64)
            for c in combo:
                key = key * 1000 + codes[c]
            n = len(np.unique(key[whole]))
            if whole.sum() >= 0.5 * row_count and n * 100.0 >= 95 * whole.sum():
                out[combo] = (int(whole.sum()), n)
        unique |= {c for c in out if len(c) == size}
    return out


def test_keys_of_sixty_columns_equal_plain_counts_in_few_jobs(spark):
    df, frame = wide(spark)
    found, count = jobs(spark, lambda: tables.composite_candidates(df, facts(frame), len(frame)).collect())
    got = {tuple(r["columns"]): (r.evaluated_row_count, r.composite_distinct_count) for r in found}
    assert got == plain_keys(frame, len(frame)) and ("c58", "c59") in got and any(len(c) == 3 for c in got)
    # A scan for the sample, one for the meetings, one per size and 128 combinations left, with
    # the jobs of their shuffles and broadcasts; there are 35,990 pairs and triples.
    assert count <= 30


def test_most_combinations_are_refuted_and_no_key_is(spark):
    df, frame = wide(spark, columns=30)
    fields = tables.fields_of(df)
    distinct = [f["distinct_count"] for f in facts(frame)]
    refuted = evidence.refuted_keys(df, fields, distinct, len(frame), 3, 0.05, 0.5)
    at = {c: i for i, c in enumerate(frame.columns)}
    keys = {tuple(at[c] for c in k) for k in plain_keys(frame, len(frame))}
    asked = [c for size in (2, 3) for c in evidence.pigeonholed(distinct, size, 0.5 * len(frame))]
    assert not refuted & keys and len(refuted) > 0.5 * len(asked)


def plain_dependencies(frame, least):
    out = {}
    for a, b in itertools.permutations(frame.columns, 2):
        both = frame[[a, b]].dropna()
        groups = both.groupby(a)[b].agg(["size", "nunique"])
        bad = int(groups["size"][groups["nunique"] > 1].sum())
        if len(both) >= 30 and 100.0 * (1 - bad / len(both)) >= least:
            out[a, b] = (len(both), bad)
    return out


@pytest.mark.parametrize("least", [98.0, 100.0])
def test_dependencies_of_many_columns_equal_plain_counts_in_few_jobs(spark, least):
    df, frame = wide(spark, columns=30)
    found, count = jobs(spark, lambda: tables.functional_dependencies(df, list(frame.columns), least).collect())
    got = {(r.determinant, r.dependent): (r.evaluated_rows, r.violating_rows) for r in found}
    wanted = plain_dependencies(frame, least)
    assert got == wanted and len(got) >= 3 and count <= 15
    assert all(r.bidirectional == ((r.dependent, r.determinant) in got) for r in found)


def test_single_grouping_equals_one_grouping_per_determinant(spark):
    df, frame = wide(spark, rows=400, columns=12)
    names = [f"c{i}" for i in range(12)]
    wanted = {a: [b for b in names if b != a][:4 + i % 5] for i, a in enumerate(names)}
    got = {(r.determinant, r.dependent): tuple(r[2:]) for r in tables.measured_dependencies(df, wanted).collect()}
    plain = {(r.determinant, r.dependent): tuple(r[2:]) for r in tables.dependency_coverage(df, names).collect()}
    assert got == {k: v for k, v in plain.items() if k[1] in wanted[k[0]]}


@pytest.mark.parametrize(("rows", "share"), [(256, 0.1), (256, 0.02), (40, 0.1), (256, 0.0), (1, 0.5), (0, 0.1)])
def test_limits_of_chance(rows, share):
    limit = evidence.most_by_chance(rows, share)
    beyond = math.fsum(math.comb(rows, k) * share ** k * (1 - share) ** (rows - k) for k in range(limit + 1, rows + 1))
    assert beyond <= evidence.SURE and 0 <= limit <= max(rows, 0)


def test_maximal_sets_and_what_they_cover():
    masks = np.array([[1, 1, 0, 0, 1], [1, 1, 0, 0, 0], [0, 0, 1, 1, 0], [0, 0, 1, 1, 0]], bool)
    assert sorted(map(tuple, evidence.maximal(masks).astype(int))) == [(0, 0, 1, 1, 0), (1, 1, 0, 0, 1)]
    assert list(evidence.covered(masks, 2)) == [(0, 1), (0, 4), (1, 4), (2, 3)]
    assert list(evidence.covered(masks, 3)) == [(0, 1, 4)]
    words = [np.array([(1 << 61) | 1, 0], np.int64), np.array([2, 1], np.int64)]
    assert evidence.bits_of(words, 64)[0].nonzero()[0].tolist() == [0, 61, 63]


def test_searches_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a int, b int")
    assert tables.functional_dependencies(empty, ["a", "b"]).count() == 0
    assert tables.composite_candidates(empty, [], 0).count() == 0
    same = spark.createDataFrame([(1, None, "x")] * 50, "a int, b int, c string")
    got = {(r.determinant, r.dependent) for r in tables.functional_dependencies(same, ["a", "b", "c"]).collect()}
    assert got == {("a", "c"), ("c", "a")}
