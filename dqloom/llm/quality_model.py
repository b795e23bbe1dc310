"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (`text_statistics`) are the only inputs. For training every
statistic is cut into at most `BINS` bins at quantiles; a tree grows level by level from
histograms of gradients and hessians over (node, statistic, bin). Trees are complete to
`DEPTH` and flattened into arrays of split statistics, thresholds and leaf values, so that a
batch of texts walks through all trees at once: a node's children are at 2i + 1 and 2i + 2.

The model is fitted on a bounded sample of labelled rows, `max_train_rows`, those with the
smallest hashes of their ids; their statistics (not their texts) come to the driver, some
250 bytes a row. Scoring covers all rows, where they lie, without a shuffle; the broadcast
model has `TREES` * 2 ** (`DEPTH` + 1) numbers.

Defined cases: null and empty texts have statistics of zero and get a score like any other;
ids whose labels are null or contradict each other aren't learnt from; of rows with equal ids
one is learnt from, all are scored; null ids are scored, never learnt from and never held
out; without labels every score is 1/2, with one kind of label near that label; columns of
the input named like results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import sliced
from .common import ship, unit_interval
from .text_statistics import NAMES, statistics

MAX_TRAIN_ROWS = 32_768
TREES = 60
DEPTH = 4
BINS = 64
RATE = 0.15
SMOOTH = 2.0
LEAST_WEIGHT = 2.0
KEEP_FROM = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Trees:
    """Complete trees: row t holds tree t, level by level."""

    base: float
    split: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.split.shape
        node = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (x[row, self.split[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosting of the logistic loss. Equal input in equal order gives an equal model."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    split, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(base, split, threshold, leaf)
    # Edges stand half-way between neighbouring values, and each value lies in one bin.
    edges = []
    for column in x.T:
        values = np.unique(column)
        some = values[np.unique(np.searchsorted(values, np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])))]
        edges.append(np.array([(v + values[i + 1]) / 2 for v, i in zip(some, np.searchsorted(values, some), strict=True) if i + 1 < len(values)]))
    place = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    usable = np.array([[b < len(e) for b in range(bins)] for e in edges])
    columns, cells = x.shape[1], x.shape[1] * bins
    flat = (np.arange(columns) * bins + place).ravel()
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            index = np.repeat((node - first) * cells, columns) + flat
            g, h = (np.bincount(index, np.repeat(w, columns), width * cells).reshape(width, columns, bins).cumsum(2) for w in (gradient, hessian))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g * g / (h + SMOOTH) + (all_g - g) ** 2 / (all_h - h + SMOOTH) - all_g ** 2 / (all_h + SMOOTH)
            gain[~(usable & (h >= LEAST_WEIGHT) & (all_h - h >= LEAST_WEIGHT))] = 0
            best = gain.reshape(width, -1).argmax(1)
            column, cut = best // bins, best % bins
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            split[t, first:first + width] = np.where(worth, column, 0)
            threshold[t, first:first + width] = [edges[c][b] if w else np.inf for c, b, w in zip(column, cut, worth, strict=True)]
            at = node - first
            right = worth[at] & (place[np.arange(len(y)), column[at]] > cut[at])
            node = 2 * node + 1 + right
        at = node - inner
        leaf[t] = rate * np.bincount(at, gradient, leaves) / (np.bincount(at, hessian, leaves) + SMOOTH)
        total += leaf[t][at]
    return Trees(base, split, threshold, leaf)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo `FOLDS`."""
    return F.crc32(id_col.cast("string")) % FOLDS


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` without its text, plus `stats` (array<double> in the order of `NAMES`)."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in (text_col, "stats")]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "__text"):
                found = statistics(batch.column("__text"))
                stats = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(NAMES), found.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stats], names=[*kept, "stats"])

    return df.select(*kept, F.col(text_col).cast("binary").alias("__text")).mapInArrow(work, schema)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(id, label, stats) of at most `max_train_rows` labelled rows outside the held-out fold."""
    told = labels.filter(F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).alias("label"), F.max(label_col).alias("most")).filter("label = most")
    told = told.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").select("id", "label", unit_interval(F.col("id").cast("string")).alias("u"))
    share = min(1.0, 2 * max_train_rows / max(1, told.count()))
    chosen = told.filter(F.col("u") <= share).orderBy("u", "id").limit(max_train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.drop("u")), "id")
    return measured(texts).groupBy("id", "label").agg(F.min("stats").alias("stats"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_train_rows: int = MAX_TRAIN_ROWS) -> Trees:
    rows = sorted(training_rows(docs, labels, id_col, text_col, label_col, max_train_rows).collect(), key=lambda r: r.id)
    x = np.array([r.stats for r in rows]).reshape(-1, len(NAMES))
    return fit_trees(x, np.array([float(r.label > 0) for r in rows]))


def score(df: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """`df` without its text, plus `score`."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (text_col, "score")]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "__text"):
                found = shared.value.score(statistics(batch.column("__text")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*kept, "score"])

    return df.select(*kept, F.col(text_col).cast("binary").alias("__text")).mapInArrow(work, schema)


def outcomes(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """How many labelled rows of each fold and label were predicted what."""
    told = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label"))
    return scored.join(told, F.col(id_col) == F.col("__id")).groupBy("held_out", "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= KEEP_FROM, 1).otherwise(0).alias("predicted"))
