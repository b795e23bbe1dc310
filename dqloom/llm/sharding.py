"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked there; a row's
fractional rank (rank - offset) / source size says where in the whole it belongs. The offset
is a seeded number in [0, 1) of the source's own, so that many sources of few rows spread
evenly, too. Sorted by fractional rank, every stretch of rows has the sources in the
mixture's proportion, and so has every shard that is cut from it. Shard sizes differ by one
row at most.

No source and no order is gathered in a task: hashes and fractional ranks are uniform, so
both ranks are taken inside small buckets, after the offsets that the buckets' counts give.

Defined cases: null sources are one source of their own; null ids are told apart by their
rows' other columns; repeated rows are placed like any others (equal rows are
interchangeable); with fewer rows than shards some
shards stay empty; an empty table gives an empty result; columns of the input named like
results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_or_empty

SHARDS = 24
SEED = "shards-1"
LEAST_BUCKETS = 64


def source_key(source: Column) -> Column:
    """Never null, and different for a null and for any text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def shuffle_key(seed: str, *columns: Column) -> Column:
    """A seeded hash in [0, 2**52) that SQL engines share."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def fraction(rank: Column, size: Column, src: Column, seed: str) -> Column:
    """Where in the whole the source's row of a rank (from 1) belongs, in (0, 1]."""
    offset = shuffle_key(seed, src) / F.lit(float(1 << 52))
    return (rank.cast("double") - offset) / size.cast("double")


def offsets(buckets: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Counts per bucket with the rows that lie before, and the rows of the partition."""
    before = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return buckets.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                          F.sum("n").over(W.partitionBy(*partition)).alias("all"))


def assign_shards(df: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id",
                  source_col: str = "source", bucket_rows: int = 50_000) -> DataFrame:
    """`df` plus `shard` and `slot` (the row's place in its shard, from 0).

    All columns travel through two shuffles; give it ids and join texts later if those
    are large.
    """
    df = df.drop(*[c for c in ("shard", "slot") if c not in (id_col, source_col)])
    columns = df.columns
    total = df.count()
    pieces = max(LEAST_BUCKETS, math.ceil(total / bucket_rows))
    others = [F.col(f"`{c}`").cast("string") for c, t in df.dtypes if c != id_col and not t.startswith(("map", "variant", "array", "struct"))]
    unnamed = F.when(F.col(id_col).isNull(), F.hex(F.xxhash64(*others))) if others else F.lit(None).cast("string")
    key = shuffle_key(seed, F.coalesce(F.col(id_col).cast("string"), unnamed))
    keyed = df.select(F.struct("*").alias("row"), source_key(F.col(source_col)).alias("src"), key.alias("h"))
    keyed = keyed.withColumn("b", F.floor(F.col("h") * F.lit(pieces) / F.lit(float(1 << 52))).cast("int"))
    counts = offsets(keyed.groupBy("src", "b").agg(F.count(F.lit(1)).alias("n")), ["src"], "b")
    ordered = [F.col("h"), *[F.col(f"row.{c}") for c in [id_col] + [
        c for c, t in df.dtypes if c != id_col and not t.startswith(("map", "variant"))]]]
    ranked = keyed.join(counts, ["src", "b"]).select(
        "row", "src", (F.col("before") + F.row_number().over(W.partitionBy("src", "b").orderBy(*ordered))).alias("rank"), "all")
    ranked = ranked.withColumn("f", fraction(F.col("rank"), F.col("all"), F.col("src"), seed))
    bucket = F.least(F.floor(F.col("f") * pieces), F.lit(pieces - 1)).cast("int")
    ranked = stored(ranked.select("row", "src", "f", bucket.alias("b")), "ranked")
    places = offsets(ranked.groupBy("b").agg(F.count(F.lit(1)).alias("n")), [], "b").select("b", "before")
    placed = ranked.join(places, "b").withColumn(
        "pos", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("f", "src")) - 1)
    placed = placed.withColumn("shard", F.expr(f"(pos * {shards}) div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "shard",
                         (F.col("pos") - first).cast("long").alias("slot"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    documents = stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")), "sizes")
    return assign_shards(documents).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def crc_table() -> list[int]:
    """The reflected polynomial 0xEDB88320 applied to each byte."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return table


def op3_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, source, strlen(t) + 8 AS size,
      xor(list_reduce([4294967295] || list_transform(range(1, strlen(t) * 2, 2),
                      lambda i: ('0x' || substr(x, i, 2))::BIGINT),
          lambda a, b: xor(a >> 8, {crc_table()}[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM d),
k AS (SELECT *, coalesce('=' || source, '') AS src,
      ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS h FROM c),
r AS (SELECT *, ((row_number() OVER (PARTITION BY src ORDER BY h, doc_id, source, size, crc))::DOUBLE
      - ('0x' || substr(md5('{SEED}:' || src), 1, 13))::BIGINT / {1 << 52}::DOUBLE)
      / (count(*) OVER (PARTITION BY src))::DOUBLE AS f FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY f, src) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, ((pos * {SHARDS}) // n)::INTEGER AS shard,
       (pos - (((pos * {SHARDS}) // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p"""
