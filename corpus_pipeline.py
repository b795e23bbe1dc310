"""Five stages from raw documents to token ids, each one of the operators in dqloom.llm.

Every stage takes what its predecessor kept. Documents are one of each group of near
duplicates when they come to the mixing stage; rows with equal id and source are one
document there. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqloom.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from dqloom.llm.common import stored, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy keeps."""
    judged = quality_rules.apply_policy(quality_rules.ledger(docs.select(*COLUMNS), keep_text=True))
    return judged.filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand on ten sources or more, in ten different texts or
    more: copies of one text stay whole, the near-dedup stage keeps one of them."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS), distinct_texts=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id. Of rows
    with equal ids one stays; rows without an id all stay."""
    found = near_dedup.near_duplicates(docs)
    chosen = found.filter("kept and doc_id is not null").select("doc_id").distinct()
    first = W.partitionBy("doc_id").orderBy(F.xxhash64("text"), "source", "lang", "n_chars")
    kept = docs.select(*COLUMNS).join(chosen, "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return kept.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it."""
    sizes = docs.select("doc_id", "source", mixing.word_count(text_or_empty()).alias("size"))
    sizes = sizes.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    sizes = stored(sizes.withColumn("weight", mixing.length_weight(F.col("size"))), "sizes")
    taken = mixing.mix(sizes, weight_col="weight").filter("copies > 0").select(
        F.col("doc_id").alias("i"), F.col("source").alias("s"), "copies")
    met = docs.join(taken, docs.doc_id.eqNullSafe(taken.i) & docs.source.eqNullSafe(taken.s))
    return met.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document of the mix."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.word_tokenizer()).drop("text")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near),
    ("mixing", mix),
    ("bpe encoding", encode),
]
#: Sketches and BPE merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "stage")
    return docs
