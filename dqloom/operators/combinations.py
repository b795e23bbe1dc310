"""Exact counts of many column combinations in little shuffle.

A row's values in one combination are 96 bits of hash. A map task sorts the hashes of about a
million rows per combination, folds equal ones and sends them cut by ranges of the hash: one
row per range, whose hashes stand in order and are written as differences, in as few bytes as
the largest needs. Ranges grow in number with the table, so one holds about `RANGE` rows, and
equal hashes of a map task are one, however many rows have them. So nothing is aggregated or
sorted row by row in the shuffle, and nothing spills.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqloom.session import ship

RANGE = 250_000
CELLS = 8_000_000
SENT = "a long, n int, first long, hashes binary, more binary, counts binary"
COUNTED = "combo int, rows long, distinct long, repeated long"


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    width = (int(numbers.max()).bit_length() + 7) // 8
    return bytes([width]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if data[0]:
        out[:, :data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(n, data[0])
    return out.view("<u8").ravel()


def folded(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (a, b) in order, each once with the sum of its counts."""
    order = np.argsort(a)
    tied = a[order[1:]] == a[order[:-1]]
    if (b[order[1:]][tied] != b[order[:-1]][tied]).any():
        order = np.lexsort((b, a))
    a, b, counts = a[order], b[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[starts], b[starts], np.add.reduceat(counts, starts)


def told_apart(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `folded`, for hashes that need no second part."""
    a = np.sort(a)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a[starts], np.zeros(len(starts), np.uint64), np.diff(starts, append=len(a)).astype(np.uint64)


def _sent(table: pa.Table, combinations: int, ranges: int) -> Iterator[pa.RecordBatch]:
    for combo in range(combinations):
        a = table[f"a{combo}"].drop_null().to_numpy().view(np.uint64)
        if not len(a):
            continue
        if f"b{combo}" in table.column_names:
            b = table[f"b{combo}"].drop_null().to_numpy().view(np.uint32)
            a, b, counts = folded(a, b, np.ones(len(a), np.uint64))
        else:
            a, b, counts = told_apart(a)
        at = ((a >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        numbers, starts = np.unique(at, return_index=True)
        rows = []
        for number, lo, hi in zip(numbers.tolist(), starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
            steps = np.diff(a[lo:hi], prepend=a[lo])
            rows.append(((combo << 32) + number, hi - lo, int(a[lo].view(np.int64)), packed(steps), packed(b[lo:hi]),
                         packed(counts[lo:hi] - np.uint64(1))))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                         names=["a", "n", "first", "hashes", "more", "counts"])


def _counted(group: pa.Table) -> pa.Table:
    parts = []
    for r in group.to_pylist():
        first = np.array([r["first"]], np.int64).view(np.uint64)
        parts.append((np.cumsum(unpacked(r["hashes"], r["n"]), dtype=np.uint64) + first, unpacked(r["more"], r["n"]),
                      unpacked(r["counts"], r["n"]) + np.uint64(1)))
    _, _, counts = folded(*[np.concatenate(c) for c in zip(*parts, strict=True)])
    return pa.table({"combo": pa.array([group["a"][0].as_py() >> 32], pa.int32()), "rows": pa.array([int(counts.sum())]),
                     "distinct": pa.array([len(counts)]), "repeated": pa.array([int(counts[counts > 1].sum())])})


def combination_counts(
    df: DataFrame, combinations: Sequence[Sequence[Column]], row_count: int, one_to_one: Collection[int] = (),
) -> DataFrame:
    """(combo, rows, distinct, repeated): rows without a null in the combination, their distinct
    values, and the rows that share theirs with another. Combinations without rows are left out.

    `one_to_one` are single columns of at most 64 bits: their 64-bit hashes differ whenever their
    values do, and take no second hash.
    """
    ship(df.sparkSession)
    wide: list[Column] = []
    for i, members in enumerate(combinations):
        complete = F.lit(True)
        for m in members:
            complete = complete & m.isNotNull()
        wide.append(F.when(complete, F.xxhash64(*members)).alias(f"a{i}"))
        if i not in one_to_one:
            wide.append(F.when(complete, F.shiftright(F.xxhash64(F.lit(2), *members), 32).cast("int")).alias(f"b{i}"))
    n, ranges = len(combinations), max(1, -(-row_count // RANGE))
    most = CELLS // n

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from _sent(pa.Table.from_batches(held), n, ranges)
                held, rows = [], 0
        if rows:
            yield from _sent(pa.Table.from_batches(held), n, ranges)

    found = df.select(*wide).mapInArrow(send, SENT).groupBy("a").applyInArrow(_counted, COUNTED)
    return found.groupBy("combo").agg(*[F.sum(c).alias(c) for c in ("rows", "distinct", "repeated")])
