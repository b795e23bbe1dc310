"""Vector codes: every part of a vector becomes the index of a codebook entry.

Components become integers floor(`scale` * x). The rows of a block are stored by dimension
as dictionary codes: per dimension the distinct integers of the block, and per row the place
of its integer among them. A round tabulates, per dimension, the squared difference of each
distinct integer to all entries; the distance of a part is then gathered from the tables by
the codes and added over the part's dimensions. So the squares are computed once per distinct
integer, not once per row, and entries' sums come from counts of (entry, code) pairs.

Blocks are written once, without a shuffle, and read in every round. A round sends one row
per used entry and position from a task; the sums have `parts` * `entries` * positions rows
at most, which the driver divides. Nothing else leaves the tasks, so neither rows nor labels
need to spread evenly. The error per label is summed before it is met with the rows.

Memory: a block holds `BLOCK_ROWS` rows or `BLOCK_VALUES` components at most.

Defined cases: rows whose vector is null, empty or of another length than that of the row
that comes first by id, or holds null or non-finite components, are dropped; with fewer rows
than entries the codebooks have as many entries as rows; equal ids are put in order by their
vectors, null ids come last; repeated rows count each; null labels are one label; columns
besides id, vector and label are not read; an empty table gives an empty result. A length
that the parts don't divide, and components so large that a distance could exceed a 64-bit
integer, raise an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import met_by_key, ship, stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 16_384
BLOCK_VALUES = 1 << 22
SUMS = "part int, entry int, position int, total long, n long"


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), refused where squared distances of the vectors could overflow."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() > math.isqrt((1 << 62) // vectors.shape[1]) // 2:
        raise ValueError("vector components are too large for distances in 64-bit integers")
    return scaled.astype(np.int64)


class Block:
    """Rows of one block by dimension: distinct integers, and a code per row."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray) -> None:
        self.values, self.codes = values, codes

    @classmethod
    def of(cls, numbers: np.ndarray) -> Block:
        found = [np.unique(column, return_inverse=True) for column in numbers.T]
        return cls([v for v, _ in found], np.array([c for _, c in found], np.uint16).reshape(numbers.shape[::-1]))

    def assigned(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per part: the nearest entry of every row (the first among equals) and its
        squared distance. `books` is parts x entries x positions."""
        width = books.shape[2]
        for part, book in enumerate(books):
            away = np.zeros((self.codes.shape[1], len(book)), np.int64)
            for position in range(width):
                d = part * width + position
                table = (self.values[d][:, None] - book[:, position]) ** 2
                away += table[self.codes[d]]
            nearest = away.argmin(1)
            yield nearest, away[np.arange(len(nearest)), nearest]

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry: the sums of its parts by position, and their number."""
        parts, entries, width = books.shape
        totals, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for part, (nearest, _) in enumerate(self.assigned(books)):
            counts[part] = np.bincount(nearest, minlength=entries)
            for position in range(width):
                d = part * width + position
                size = len(self.values[d])
                met = np.bincount(nearest * size + self.codes[d], minlength=entries * size)
                totals[part, :, position] = met.reshape(entries, size) @ self.values[d]
        return totals, counts


def _packed(scale: int, dim: int, label_type: pa.DataType):
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            numbers = np.array(rows["v"].combine_chunks().flatten()).reshape(-1, dim)
            made = Block.of(integers(numbers, scale))
            return pa.RecordBatch.from_arrays([
                pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())), pa.array([rows["label"].to_pylist()], pa.list_(label_type)),
                pa.array([[len(v) for v in made.values]], pa.list_(pa.int32())), pa.array([np.concatenate(made.values).tobytes()], pa.binary()),
                pa.array([made.codes.tobytes()], pa.binary())], names=["ids", "labels", "sizes", "distinct", "codes"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= most:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, most))
                held = rows.slice(most).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return pack


def _opened(batch: pa.RecordBatch, row: int) -> Block:
    sizes = batch.column("sizes")[row].as_py()
    values = np.frombuffer(batch.column("distinct")[row].as_py(), np.int64)
    codes = np.frombuffer(batch.column("codes")[row].as_py(), np.uint16)
    return Block(np.split(values, np.cumsum(sizes)[:-1]), codes.reshape(len(sizes), -1))


def _round(books: np.ndarray):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                more, n = _opened(batch, row).sums(books)
                totals += more
                counts += n
        part, entry, position = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, books.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(position, pa.int32()),
             pa.array(totals[part, entry, position]), pa.array(counts[part, entry])], names=["part", "entry", "position", "total", "n"])

    return summed


def _coded(books: np.ndarray):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = list(_opened(batch, row).assigned(books))
                codes = np.array([nearest for nearest, _ in found], np.uint8).T
                error = np.sum([away for _, away in found], axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, batch.column("labels")[row].values,
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["id", "label", "code", "error"])

    return coded


def finite(vector: str | F.Column) -> F.Column:
    """Whether a vector has components, none of them null or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code (a byte per part), error) of all kept rows, and the codebooks
    (parts x entries x positions)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte per part: 1 to 256 entries")
    spark = df.sparkSession
    ship(spark)
    label_type = df.select(label_col).schema[0].dataType
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                     F.col(vector_col).cast("array<double>").alias("v")).filter(finite("v"))
    shape = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label_type),
                          T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    first = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], shape), np.zeros((parts, 0, 0), np.int64)
    dim = len(first[0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("v") == dim)
    first = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    books = integers(np.array(first), scale).reshape(len(first), parts, -1).transpose(1, 0, 2)

    packed = T.StructType([
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label_type)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("distinct", T.BinaryType()), T.StructField("codes", T.BinaryType())])
    arrow_label = _arrow_type(label_type)
    blocks = stored(rows.mapInArrow(_packed(scale, dim, arrow_label), packed), "blocks")
    for _ in range(rounds):
        found = blocks.select("sizes", "distinct", "codes").mapInArrow(_round(books), SUMS)
        books = books.copy()
        for r in found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part, r.entry, r.position] = r.total // r.n
    return blocks.mapInArrow(_coded(books), shape), books


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """`codes` plus `vector`: the middle of the entries' cells that the code names."""
    middles = F.array(*[F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in entry]) for entry in book]) for book in books])
    byte = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.get(F.get(middles, F.lit(p)), byte(p)) for p in range(len(books))]))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_query(spark, sf_dir: str) -> DataFrame:
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    codes = stored(found, "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return met_by_key(codes, by_label, "label").select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_sql() -> str:
    """Every round as its own step: assign by all squared differences, then floor of means."""
    steps = [f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT *, len(v) // {PARTS} AS w FROM k WHERE len(v) = (SELECT len(v) FROM k WHERE rid = 1)),
x AS MATERIALIZED (SELECT rid, (i - 1) // w AS part, (i - 1) % w AS pos, floor({SCALE} * v[i])::BIGINT AS n
      FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM d)),
b0 AS MATERIALIZED (SELECT part, (dense_rank() OVER (ORDER BY rid) - 1)::BIGINT AS entry, pos, n AS c FROM x
      WHERE rid IN (SELECT rid FROM d ORDER BY rid LIMIT {ENTRIES}))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT rid, part, min(away * {ENTRIES} + entry) AS best FROM (
      SELECT rid, part, entry, sum((n - c) * (n - c))::BIGINT AS away FROM x JOIN b{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
      SELECT part, best % {ENTRIES} AS entry, pos, ((sum(n) - ((sum(n) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM x JOIN a{r} USING (rid, part) GROUP BY ALL) USING (part, entry, pos))""")
    return ",".join(steps) + f""",
o AS (SELECT rid, string_agg(lower(printf('%02x', best % {ENTRIES})), '' ORDER BY part) AS code,
      sum(best // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY rid),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS s FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM d JOIN o USING (rid), h"""
