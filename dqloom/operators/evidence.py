"""What a bounded sample of rows proves about keys and dependencies.

A sampled row that meets another row with equal values in some columns shows that these
columns tell no key apart at that row; one that meets equal values in A and different ones
in B shows that A -> B is broken at that row. More meetings only add to what is shown, so
counts of such rows are lower bounds, however few of the meetings are looked at.

A key that is unique by 95% leaves at most 10% of the rows with an equal partner, and a
dependency that holds on 98% leaves 2% of the rows broken. If far more of `SAMPLED` random
rows show it, so many that chance explains it with a probability below `SURE`, the
combination is refuted. What is not refuted is counted exactly elsewhere.

The table is scanned once for the sample and once for the meetings, whatever its width. A
row is repeated once per column by the engine's expand operator and meets the sample in a
broadcast join on (column, value): `SAMPLED` rows per column. Values are compared as 64-bit
hashes: rows that seem to meet by chance would need to do so in a tenth of the sample.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqloom.functions.missing import NESTED, value_text
from dqloom.operators.frequency import Field
from dqloom.session import ship

SAMPLED = 256
SURE = 1e-12
WORD = 62
MEETINGS = 64


def hashed(field: Field) -> Column:
    """A value as a 64-bit hash, null where it is missing."""
    value = field.value
    if isinstance(field.dtype, (*NESTED, T.BinaryType)):
        value = value_text(value, field.dtype)
    return F.when(value.isNotNull(), F.xxhash64(value))


def most_by_chance(rows: int, share: float) -> int:
    """How many of `rows` random rows may show what at most `share` of all rows show; more
    would happen with a probability below SURE."""
    tail, at = 1.0, -1
    while tail > SURE and at < rows:
        at += 1
        tail -= math.comb(rows, at) * share ** at * (1 - share) ** (rows - at)
        # Differences of nearly equal numbers: sum the rest directly once it is small.
        if tail < 1e-6:
            tail = math.fsum(math.comb(rows, k) * share ** k * (1 - share) ** (rows - k) for k in range(at + 1, rows + 1))
    return at


@dataclass(frozen=True)
class Sample:
    """Hashed rows of a table, and a random few of them."""

    fields: Sequence[Field]
    cells: DataFrame
    rows: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, fields: Sequence[Field], sampled: int = SAMPLED) -> Sample:
        cells = df.select(*[hashed(f).alias(f"c{i}") for i, f in enumerate(fields)])
        found = cells.withColumn("order", F.rand(7)).orderBy("order").limit(sampled).drop("order").collect()
        known = np.array([[v is not None for v in r] for r in found], bool).reshape(-1, len(fields))
        rows = np.array([[v or 0 for v in r] for r in found], np.int64).reshape(-1, len(fields))
        return cls(fields, cells, rows, known)

    def words(self, condition: str) -> list[str]:
        """Bits of the columns for which a condition on r (row) and s (sample) holds."""
        out = []
        for start in range(0, len(self.fields), WORD):
            bits = [f"CASE WHEN {condition.format(r=f'c{i}', s=f's{i}')} THEN {1 << (i - start)}L ELSE 0L END"
                    for i in range(start, min(start + WORD, len(self.fields)))]
            out.append(" + ".join(bits))
        return out

    def meetings(self, columns: Sequence[int], rates: Mapping[int, float] | None = None) -> DataFrame:
        """(s, a, c..., s...): rows that agree with sampled row s in column a. A column's
        rate is the share of the rows that is looked at."""
        spark = self.cells.sparkSession
        probe = [(int(a), int(self.rows[s, a]), s) for s in range(len(self.rows)) for a in columns if self.known[s, a]]
        side = [(s, *[int(v) if k else None for v, k in zip(row, known, strict=True)])
                for s, (row, known) in enumerate(zip(self.rows, self.known, strict=True))]
        looked = [f"c{i}" if (rates or {}).get(i, 1.0) >= 1 else F.when(F.rand(11 + i) < rates[i], F.col(f"c{i}")) for i in columns]
        wide = self.cells.select("*", *[(F.col(x) if isinstance(x, str) else x).alias(f"j{i}") for i, x in zip(columns, looked, strict=True)])
        tall = wide.unpivot([f"c{i}" for i in range(len(self.fields))], [f"j{i}" for i in columns], "of", "v").filter("v IS NOT NULL")
        tall = tall.withColumn("a", F.substring("of", 2, 9).cast("int")).drop("of")
        met = tall.join(F.broadcast(spark.createDataFrame(probe, "a int, v long, s int")), ["a", "v"])
        return met.join(F.broadcast(spark.createDataFrame(side, "s int, " + ", ".join(f"s{i} long" for i in range(len(self.fields))))), "s")


def bits_of(words: Sequence[np.ndarray], columns: int) -> np.ndarray:
    """Rows x columns, from packed words."""
    out = np.zeros((len(words[0]), columns), bool)
    for i in range(columns):
        out[:, i] = (words[i // WORD] >> (i % WORD)) & 1
    return out


def covered(masks: np.ndarray, size: int) -> Iterator[tuple[int, ...]]:
    """The combinations of `size` columns that lie in one of the masks."""
    def inside(rows: np.ndarray, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        last = chosen[-1] + 1 if chosen else 0
        if len(chosen) == size - 2:
            small = rows[:, last:].astype(np.float32)
            pairs = np.triu(small.T @ small > 0, 1)
            for i, j in np.argwhere(pairs):
                yield (*chosen, last + int(i), last + int(j))
            return
        for i in range(last, rows.shape[1]):
            some = rows[rows[:, i]]
            if len(some):
                yield from inside(some, (*chosen, i))

    if size == 1:
        yield from ((int(i),) for i in np.flatnonzero(masks.any(0)))
    else:
        yield from inside(masks, ())


def maximal(masks: np.ndarray) -> np.ndarray:
    """The masks that lie in no other one: the largest column sets that are no key."""
    masks = np.unique(masks, axis=0)
    masks = masks[np.argsort(-masks.sum(1), kind="stable")]
    kept = np.zeros((0, masks.shape[1]), bool)
    for mask in masks:
        if not (kept[:, mask].all(1)).any():
            kept = np.vstack([kept, mask])
    return kept


def refuted_keys(
    df: DataFrame, fields: Sequence[Field], distinct: Sequence[int], row_count: int, width: int, excess: float, pigeonhole: float,
) -> set[tuple[int, ...]]:
    """Combinations of two to `width` columns (positions in `fields`) with more than `excess`
    of their rows in excess of one per value.

    A combination that could be a key holds a column with at least the `width`-th root of
    `pigeonhole` * rows distinct values, and all its partners meet there; so only such
    columns are joined on, and their groups are small. Every sampled row's agree sets are
    reduced to the maximal ones and their combinations are counted, group by group.
    """
    selective = [i for i, d in enumerate(distinct) if d ** width >= pigeonhole * row_count]
    if not selective or len(fields) < 2:
        return set()
    ship(df.sparkSession)
    sample = Sample.of(df, fields)
    # Each pair of rows once: at the first selective column in which they agree.
    first = "CASE " + " ".join(f"WHEN c{i} = s{i} THEN {i}" for i in selective) + " END"
    agree = sample.words("{r} = {s}")
    names = [f"w{i}" for i in range(len(agree))]
    met = sample.meetings(selective).filter(f"a = {first}").groupBy("s", *[F.expr(w).alias(n) for w, n in zip(agree, names, strict=True)]).agg(
        F.count(F.lit(1)).alias("n"))
    columns, known = len(fields), sample.known
    least = pigeonhole * row_count

    def combinations(group: pa.Table) -> pa.Table:
        masks = bits_of([group[n].to_numpy() for n in names], columns)
        # The row meets itself once; only another equal row is a partner in all columns.
        itself = (masks == known[group["s"][0].as_py()]).all(1) & (group["n"].to_numpy() == 1)
        kept = maximal(masks[~itself])
        found = [",".join(map(str, c)) for size in range(2, min(width, columns) + 1) for c in covered(kept, size)
                 if math.prod(distinct[i] for i in c) >= least]
        return pa.table({"combination": pa.array(found, pa.string())})

    seen = met.groupBy("s").applyInArrow(combinations, "combination string").groupBy("combination").agg(F.count(F.lit(1)).alias("n"))
    whole, out = known.astype(int), set()
    limits = [most_by_chance(m, min(1.0, 2 * excess)) for m in range(len(known) + 1)]
    for r in seen.filter(F.col("n") > limits[0]).collect():
        chosen = tuple(map(int, r.combination.split(",")))
        if r.n > limits[int(whole[:, chosen].all(1).sum())]:
            out.add(chosen)
    return out


def refuted_dependencies(
    df: DataFrame, fields: Sequence[Field], broken: float, distinct: Sequence[float], row_count: int,
) -> np.ndarray:
    """determinant x dependent: whether more than `broken` of the rows break the dependency.

    About `MEETINGS` rows of each sampled row's group are looked at.
    """
    sample = Sample.of(df, fields)
    rates = {i: min(1.0, MEETINGS * max(1.0, d) / max(1, row_count)) for i, d in enumerate(distinct)}
    differ = sample.words("{r} <> {s}")
    met = sample.meetings(range(len(fields)), rates).groupBy("s", "a").agg(
        *[F.expr(f"bit_or({w})").alias(f"w{i}") for i, w in enumerate(differ)])
    shown = np.zeros((len(fields), len(fields)), int)
    for r in met.collect():
        shown[r.a] += bits_of([np.array([w], np.int64) for w in r[2:]], len(fields))[0]
    known = sample.known.astype(int)
    both = known.T @ known
    limits = np.array([most_by_chance(m, broken) for m in range(len(known) + 1)])
    return shown > limits[both]


def pigeonholed(distinct: Sequence[int], size: int, least: float) -> Iterator[tuple[int, ...]]:
    """Combinations of `size` columns whose distinct counts multiply to `least` or more."""
    for c in itertools.combinations(range(len(distinct)), size):
        if math.prod(distinct[i] for i in c) >= least:
            yield c
