"""Cross-site boilerplate lines by distinct-site spread.

Every line is hashed, and the sites (sources) on which it occurs go into a HyperLogLog
sketch per hash; sketches merge in map tasks and after the shuffle, so a line that stands
in a third of all documents costs one sketch per task. Estimates far from the threshold
decide at once. Lines whose estimate lies within `MARGIN` standard errors of it, and one
site at least, get an exact count of distinct sites. Lines on `min_sites` sites or more
are boilerplate and leave all documents.

Lines are compared without leading and trailing white space, by 64-bit hashes. Up to
`BROADCAST_HASHES` boilerplate hashes (16 MB) are broadcast to rewrite the texts where
they lie; beyond that documents meet their boilerplate hashes by a join.

Copies of one text over many sites make its lines look like boilerplate and are emptied
alike. With `distinct_texts` a line must also stand in `min_sites` different texts, so
exact copies stay whole for a near-dedup to choose from; near copies are different texts.

Defined cases: blank lines never count and are never removed; null and empty texts stay as
they are; a null site is a site of its own; a document of boilerplate alone keeps an empty
text; repeated rows are cleaned each; columns named like results are replaced; other
columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import sliced
from .common import WORD_SPACE_CHARS, free_name, ship, stored
from .sharding import source_key

MIN_SITES = 10
LG_K = 10
MARGIN = 5
BROADCAST_HASHES = 2_000_000
RESULTS = ("n_lines", "n_removed")


def _lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WORD_SPACE_CHARS))), lambda x: x != "")


def line_sites(df: DataFrame, text_col: str, site_col: str) -> DataFrame:
    hashes = F.transform(_lines(F.col(text_col)), lambda x: F.xxhash64(x))
    return df.select(source_key(F.col(site_col)).alias("site"), F.explode(F.array_distinct(hashes)).alias("h"))


def boilerplate(df: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source",
                distinct_texts: bool = False) -> DataFrame:
    """The hashes (h) of lines that occur on `min_sites` sites or more, with `distinct_texts`
    also in as many different texts."""
    sites = line_sites(df, text_col, site_col)
    error = 1.04 / 2 ** (LG_K / 2)
    band = max(1.0, MARGIN * error * min_sites)
    spread = stored(sites.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
                    .select("h", F.hll_sketch_estimate("sketch").alias("sites"))
                    .filter(F.col("sites") >= min_sites - band), "spread")
    near = spread.filter(F.col("sites") <= min_sites + band).select("h")
    if near.count() <= BROADCAST_HASHES:
        near = F.broadcast(near)
    exact = sites.join(near, "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites)
    found = stored(spread.filter(F.col("sites") > min_sites + band).select("h").unionByName(exact.select("h")), "boilerplate")
    if not distinct_texts:
        return found
    held = df.select(F.xxhash64(F.col(text_col)).alias("t"), F.explode(F.array_distinct(
        F.transform(_lines(F.col(text_col)), lambda x: F.xxhash64(x)))).alias("h"))
    wanted = F.broadcast(found) if found.count() <= BROADCAST_HASHES else found
    texts = held.join(wanted, "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("texts"))
    return stored(texts.filter(F.col("texts") >= min_sites).select("h"), "boilerplate")


def remove_lines(df: DataFrame, hashes: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` without the lines of `hashes` (h), plus `n_lines` (not blank) and `n_removed`."""
    df = df.drop(*RESULTS)
    if hashes.count() <= BROADCAST_HASHES:
        return _remove_in_place(df, [r.h for r in hashes.collect()], text_col)
    key = free_name(df, "_key")
    keyed = df.withColumn(key, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    held = keyed.select(key, F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: F.xxhash64(x)))).alias("h"))
    bad = held.distinct().join(hashes, "h").groupBy(key).agg(F.collect_set("h").alias("_bad"))
    joined = keyed.join(bad, key, "left")
    known = F.coalesce(F.col("_bad"), F.array().cast("array<bigint>"))

    def stays(x: Column) -> Column:
        return ~F.array_contains(known, F.xxhash64(F.btrim(x, F.lit(WORD_SPACE_CHARS)))) | (F.btrim(x, F.lit(WORD_SPACE_CHARS)) == "")

    n = F.coalesce(F.size(_lines(F.col(text_col))), F.lit(0)).cast("long")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), stays), "\n")
    kept = F.coalesce(F.size(_lines(left)), F.lit(0)).cast("long")
    return joined.select(*[left.alias(c) if c == text_col else F.col(c) for c in df.columns],
                         n.alias("n_lines"), F.when(F.col(text_col).isNull(), 0).otherwise(n - kept).cast("long").alias("n_removed"))


def _remove_in_place(df: DataFrame, hashes: list[int], text_col: str) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(frozenset(h & 0xFFFFFFFFFFFFFFFF for h in hashes))
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in RESULTS]])
    place = df.columns.index(text_col)
    space = WORD_SPACE_CHARS

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        bad = shared.value
        for whole in batches:
            for batch in sliced(whole, text_col):
                texts, lines, removed = [], [], []
                for text in batch.column(text_col).to_pylist():
                    n = gone = 0
                    if text:
                        left = []
                        for line in text.split("\n"):
                            bare = line.strip(space)
                            n += bare != ""
                            # Spark's xxhash64 starts from 42.
                            if bare and xxh64_intdigest(bare.encode(), 42) in bad:
                                gone += 1
                            else:
                                left.append(line)
                        if gone:
                            text = "\n".join(left)
                    texts.append(text)
                    lines.append(n)
                    removed.append(gone)
                columns = list(batch.columns)
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())],
                                                 names=[*batch.schema.names, *RESULTS])

    return df.mapInArrow(cleaned, schema)


def dedup_lines(df: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source",
                distinct_texts: bool = False) -> DataFrame:
    return remove_lines(df, boilerplate(df, min_sites, text_col, site_col, distinct_texts), text_col)


def op9_query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def lines_sql(documents: str = "documents") -> str:
    """`documents` with cleaned texts, n_lines and n_removed, in DuckDB SQL."""
    bare = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
SELECT d.* EXCLUDE (text), CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(text, chr(10)),
         lambda x: NOT list_contains(bad, {bare})), chr(10)) END AS text,
       coalesce(len(list_filter(string_split(text, chr(10)), lambda x: {bare} <> '')), 0)::BIGINT AS n_lines,
       coalesce(len(list_filter(string_split(text, chr(10)), lambda x: list_contains(bad, {bare}))), 0)::BIGINT AS n_removed
FROM {documents} d CROSS JOIN (SELECT coalesce(list(line), []) AS bad FROM (
  SELECT line FROM (SELECT source, {bare} AS line FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM {documents}))
  WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) >= {MIN_SITES}))"""


def op9_sql() -> str:
    return lines_sql("(SELECT doc_id, text, source FROM documents)")
