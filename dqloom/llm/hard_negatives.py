"""Hard-negative mining by a vertical scan with branch and bound.

Rows are dealt to blocks that keep their components by dimension. An anchor reads a block's
dimensions in the order of its own descending magnitudes. What the dimensions not yet read
can add lies between the sums of their least and greatest contributions, from the block's
minimum and maximum per dimension; with these bounds the candidates shrink after every few
dimensions, until the exact scores of the few that are left decide.

Two scans are made. The first finds each anchor's best rows of its own label, its positives.
Their scores set the windows in which negatives must lie. In the second scan a candidate
stays while its bounds meet a window whose best rows so far, those surely inside, don't
surely beat it.

Every block is shuffled once per scan and held by one task, through which all anchors are
streamed in batches: rows and anchors share one sorted stream, rows of a block first. A task
returns the best few per anchor and window, and these are ranked over all blocks. Neither
labels nor ids decide where a row goes, so a label with a third of all rows spreads evenly.

Memory: a block holds about `BLOCK_VALUES` components, the anchors come in Arrow batches.

Defined cases: rows with a null label, a null or empty vector, or null or non-finite
components take no part; vectors of different lengths don't meet; null ids are no anchors and
come last among equal scores; a repeated row is another row, also for its own copy; anchors
without positives, and positives with negative scores (their window is empty), give no rows;
columns besides id, label and vector are not read; an empty table gives an empty result.
Components so large that a score could exceed a 64-bit integer raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, stored
from .vector_codes import finite

POSITIVES = 5
NEGATIVES = 5
WINDOW = (80, 100)
SCALE = 256
BLOCK_VALUES = 1 << 22
SPREAD_ROWS = 2_048
SPREAD = 16
STEP = 8
FIRST = "rid long, id long, score long"
LATER = "rid long, window long, id long, score long"
LAST_ID = np.iinfo(np.int64).max


class Block:
    """Rows by dimension, with each dimension's range."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.rids, self.ids, self.labels = rids, ids, labels
        self.low, self.high = vectors.min(0), vectors.max(0)
        self.most = max(abs(int(self.low.min())), abs(int(self.high.max())))
        narrow = np.int32 if self.most < 1 << 31 else np.int64
        self.columns = np.ascontiguousarray(vectors.T, narrow)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, shrink: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of `alive` that `shrink` leaves, and their exact scores.

        `shrink(scores, least, greatest)` says which candidates stay, given their scores so
        far and the least and greatest sum that the dimensions left can add.
        """
        reach = len(anchor) * self.most * max(1, int(np.abs(anchor).max()))
        if reach >= 1 << 63:
            raise ValueError("vector components are too large for scores in 64-bit integers")
        kind = np.int32 if reach < 1 << 31 and self.columns.dtype == np.int32 else np.int64
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[:np.count_nonzero(anchor)]
        ends = np.sort([anchor[order] * self.low[order], anchor[order] * self.high[order]], axis=0)
        least, greatest = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in ends)
        scores = np.zeros(len(alive), kind)
        for read in range(0, len(order), STEP):
            for d in order[read:read + STEP]:
                column = self.columns[d]
                if len(alive) < len(column):
                    column = column[alive]
                scores += column * kind(anchor[d])
            at = min(read + STEP, len(order))
            stays = shrink(scores, int(least[at]), int(greatest[at]))
            if not stays.all():
                alive, scores = alive[stays], scores[stays]
            if not len(alive):
                break
        return alive, scores.astype(np.int64)

    def best(self, alive: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `k` by score, smaller ids first."""
        if len(alive) > k:
            close = scores >= np.partition(scores, -k)[-k]
            alive, scores = alive[close], scores[close]
        order = np.lexsort((self.ids[alive], -scores))[:k]
        return alive[order], scores[order]

    def positives(self, rid: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        alive = np.flatnonzero((self.labels == label) & (self.rids != rid))

        def shrink(scores: np.ndarray, least: int, greatest: int) -> np.ndarray:
            if len(scores) <= k:
                return np.ones(len(scores), bool)
            return scores >= int(np.partition(scores, -k)[-k]) + least - greatest

        return self.best(*self.scan(anchor, alive, shrink), k)

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per window (least and greatest score) its number and best rows."""
        def shrink(scores: np.ndarray, least: int, greatest: int) -> np.ndarray:
            stays = np.zeros(len(scores), bool)
            for low, high in windows:
                bar = low - greatest
                inside = scores[(scores >= low - least) & (scores <= high - greatest)]
                if len(inside) >= k:
                    bar = max(bar, int(np.partition(inside, -k)[-k]) + least - greatest)
                stays |= (scores >= bar) & (scores <= high - least)
            return stays

        alive, scores = self.scan(anchor, np.flatnonzero(self.labels != label), shrink)
        for number, (low, high) in enumerate(windows):
            fits = (scores >= low) & (scores <= high)
            yield number, *self.best(alive[fits], scores[fits], k)


def bounds(score: int, window: tuple[int, int]) -> tuple[int, int]:
    """The least and greatest negative score for a positive's score."""
    return -(-window[0] * score // 100), window[1] * score // 100


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _streamed(work: Callable):
    """Feeds `work(block, anchors)` from a stream of rows ordered by length, block and kind:
    the rows of a block (kind 0), then its anchors (kind 1)."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = None, [], None
        for batch in batches:
            marks = np.array([batch.column(c).to_numpy() for c in ("dim", "block", "kind")], np.int64).T
            starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(starts, starts[1:], strict=False):
                dim, number, kind = marks[a].tolist()
                piece = batch.slice(a, b - a)
                if (dim, number) != place:
                    place, held, block = (dim, number), [], None
                if kind == 0:
                    held.append(piece)
                    continue
                if held:
                    rows, held = pa.Table.from_batches(held).combine_chunks().to_batches()[0], []
                    block = Block(rows.column("rid").to_numpy(), rows.column("id").fill_null(LAST_ID).to_numpy(),
                                  rows.column("label").to_numpy(), _vectors(rows.column("v"), dim))
                if block is not None:
                    yield from work(block, piece, dim)

    return stream


def _positives(k: int):
    def work(block: Block, anchors: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
        rids, labels = anchors.column("rid").to_numpy(), anchors.column("label").to_numpy()
        found = [block.positives(r, l, v, k) for r, l, v in zip(rids, labels, _vectors(anchors.column("v"), dim), strict=True)]
        yield _rows(block, [rids.repeat([len(f[0]) for f in found])], ["rid"], found)

    return _streamed(work)


def _negatives(k: int, window: tuple[int, int]):
    def work(block: Block, anchors: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
        rids, labels, asked = anchors.column("rid").to_numpy(), anchors.column("label").to_numpy(), anchors.column("windows").to_pylist()
        found, owner, score = [], [], []
        for r, l, v, at in zip(rids, labels, _vectors(anchors.column("v"), dim), asked, strict=True):
            for number, rows, scores in block.negatives(l, v, [bounds(s, window) for s in at], k):
                found.append((rows, scores))
                owner += [r] * len(rows)
                score += [at[number]] * len(rows)
        yield _rows(block, [owner, score], ["rid", "window"], found)

    return _streamed(work)


def _rows(block: Block, front: list, names: list[str], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    ids = block.ids[np.concatenate([none, *[f[0] for f in found]])]
    arrays = [*[pa.array(np.asarray(c, np.int64)) for c in front], pa.array(ids, pa.int64(), mask=ids == LAST_ID),
              pa.array(np.concatenate([none, *[f[1] for f in found]]))]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "id", "score"])


def mine(df: DataFrame, is_anchor: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is a condition on the input's columns. Negatives score between `window[0]`
    and `window[1]` per cent of the positive's score. Labels are integers.
    """
    spark = df.sparkSession
    ship(spark)
    chosen = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                     F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(chosen, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("label").isNotNull() & finite("v")).withColumn("v", F.transform("v", lambda x: x * F.lit(float(scale))))
    too_large = F.exists("v", lambda x: F.abs(x) >= float(1 << 62))
    whole = F.when(too_large, F.raise_error(F.lit("vector components are too large"))).otherwise(
        F.transform("v", lambda x: F.floor(x).cast("long")))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "label", F.size("v").alias("dim"), whole.alias("v"), "anchor"), "rows")

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    most = max(1, BLOCK_VALUES // size.dim)
    blocks = max(1, math.ceil(size.n / most), min(SPREAD, math.ceil(size.n / SPREAD_ROWS)))
    no_windows = F.lit(None).cast("array<long>")
    dealt = rows.select("dim", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"),
                        "rid", "id", "label", "v", no_windows.alias("windows"))

    def streamed(asking: DataFrame, work: Callable, shape: str) -> DataFrame:
        spread = asking.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                               "rid", "id", "label", "v", "windows")
        by = ["dim", "block"]
        return dealt.unionByName(spread).repartition(2 * blocks, *by).sortWithinPartitions(*by, "kind").mapInArrow(work, shape)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    anchors = rows.filter("anchor")
    near = stored(first(streamed(anchors.withColumn("windows", no_windows), _positives(positives), FIRST), ["rid"], positives), "positives")
    asked = near.filter("score >= 0").groupBy("rid").agg(F.collect_set("score").alias("windows"))
    far = first(streamed(anchors.join(asked, "rid"), _negatives(negatives, window), LATER), ["rid", "window"], negatives)
    met = near.select("rid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        far.select("rid", F.col("window").alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"),
        ["rid", "positive_score"])
    return met.join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return mine(rows, "vec_id % 100 = 0")


def op12_sql() -> str:
    return f"""
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, a.label = r.label AS same, r.rid AS other, r.vec_id, list_dot_product(a.v, r.v)::BIGINT AS score
      FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.rid <> r.rid AND len(a.v) = len(r.v)),
p AS (SELECT rid, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.rid, p.other ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.rid = s.rid AND NOT same AND {WINDOW[0]} * positive_score <= 100 * score AND 100 * score <= {WINDOW[1]} * positive_score
QUALIFY rank <= {NEGATIVES}"""
