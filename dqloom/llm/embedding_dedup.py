"""Near-duplicate embeddings by one navigable small-world graph per shard.

Equal vectors are one class. Classes are dealt to shards by hash; each shard builds its
graph in one task and audits it: vectors at the threshold's distance from a sample of its
own are searched for, and the beam doubles until the recall against brute force, a mean
over queries, is `AUDIT_RECALL`. Queries with fewer links than the first beam and queries
with more are audited apart, so a large group does not hide what small ones lose; where
few of the sample have few links, more are drawn. The graphs are stored as a table of nodes. Every class then queries
every shard, in blocks; where all of a beam is linked the beam widens, up to a quarter of
the shard, beyond which the shard is compared in full. So neither large groups nor bad
graphs lose links. Found links are verified by cosine in double precision.

A task returns link counts and a spanning forest, never pairs, so what is shuffled stays
linear in the input however many links a group has. Components are the union of forests.

Memory: a shard holds up to `SHARD_ROWS` vectors and a block up to `BLOCK_ROWS`. Up to
512k vectors there are eight shards at most, beyond that as many as the rows ask for.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows with a null id, link with nothing, are their own component and are
kept; vectors of different lengths don't link; rows with equal ids are one node of the
components, each with its own count; repeated rows count as links of each other; columns
besides id and vector are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, ship, stored
from .hnsw import BATCH, Graph, levels_of

THRESHOLD = 0.9
SHARDS = 8
SHARD_ROWS = 65_536
BLOCK_ROWS = 16_384
FIRST_BEAM = 16
AUDITED = 64
AUDIT_DRAWS = 16
AUDIT_RECALL = 0.99
NODES = "dim int, shard int, node int, level int, beam int, key binary, rep long, m long, unit binary, links array<binary>"
FOUND = "key binary, n long, a long, b long"


def unit_bytes(values: list | None) -> bytes | None:
    """The vector at length 1 in double precision, or nothing."""
    if not values or any(v is None for v in values):
        return None
    vector = np.asarray(values, np.float64)
    if not np.isfinite(vector).all() or not vector.any():
        return None
    vector = vector / np.abs(vector).max()
    return (vector / np.linalg.norm(vector)).tobytes()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_pylist()
        units = [None if i is None else unit_bytes(v) for i, v in zip(ids, batch.column("v").to_pylist(), strict=True)]
        keys = [u and hashlib.blake2b(u, digest_size=16).digest() for u in units]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([u and len(u) // 8 for u in units], pa.int32()),
             pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["id", "dim", "key", "unit"])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def links_of(graph: Graph, exact: np.ndarray, queries: np.ndarray, beam: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) with cosine >= threshold, batch after batch."""
    slack, low = threshold - 1e-4, queries.astype(np.float32)
    waiting, width = np.arange(len(queries)), beam
    while len(waiting):
        full, saturated = width * 4 >= len(exact), []
        for start in range(0, len(waiting), BATCH):
            some = waiting[start:start + BATCH]
            if full:
                q, ids = np.nonzero(low[some] @ graph.vectors.T >= slack)
            else:
                ids, sims = graph.search(low[some], width)
                open_end = sims.min(1) >= slack
                saturated.append(some[open_end])
                sims[open_end] = -np.inf
                q, place = np.nonzero(sims >= slack)
                ids = ids[q, place]
            for a in range(0, len(q), 1 << 16):
                q1, ids1 = some[q[a:a + (1 << 16)]], ids[a:a + (1 << 16)]
                sure = np.einsum("nd,nd->n", queries[q1], exact[ids1]) >= threshold
                yield q1[sure], ids1[sure]
        waiting, width = (np.zeros(0, int) if full else np.concatenate(saturated)), width * 4


def _audit_queries(exact: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries near vectors of the shard and their numbers of links: a spread sample, and
    others until `AUDITED` of them have fewer links than `FIRST_BEAM`."""
    random = np.random.default_rng(7)
    near = min(1.0, threshold + 0.005)
    spread = np.linspace(0, len(exact) - 1, min(AUDITED, len(exact))).astype(int)
    rest = np.setdiff1d(random.permutation(len(exact))[:AUDITED * AUDIT_DRAWS], spread)
    random.shuffle(rest)
    queries, truth, few = [], [], 0
    for start in range(-AUDITED, len(rest), AUDITED):
        own = exact[spread if start < 0 else rest[start:start + AUDITED]]
        aside = random.standard_normal(own.shape)
        aside -= (aside * own).sum(1)[:, None] * own
        norm = np.linalg.norm(aside, axis=1)[:, None]
        some = near * own + math.sqrt(1 - near * near) * aside / np.where(norm > 0, norm, 1)
        count = (some @ exact.T >= threshold).sum(1)
        small = (count > 0) & (count < FIRST_BEAM)
        taken = (count > 0) if start < 0 else small & (np.cumsum(small) <= AUDITED - few)
        few += int((small & taken).sum())
        queries.append(some[taken])
        truth.append(count[taken])
        if few >= AUDITED:
            break
    return np.concatenate(queries), np.concatenate(truth)


def audited_beam(graph: Graph, exact: np.ndarray, threshold: float) -> int:
    """The narrowest beam that passes, from `FIRST_BEAM` on."""
    queries, truth = _audit_queries(exact, threshold)
    kinds = [kind for kind in (truth < FIRST_BEAM, truth >= FIRST_BEAM) if kind.any()]
    beam = FIRST_BEAM
    while beam * 4 < len(exact):
        found = np.zeros(len(queries))
        for q, _ in links_of(graph, exact, queries, beam, threshold):
            np.add.at(found, q, 1)
        if all((found[kind] / truth[kind]).mean() >= AUDIT_RECALL for kind in kinds):
            break
        beam *= 2
    return beam


def _build(threshold: float):
    def build(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        keys = table["key"].to_pylist()
        levels = levels_of(np.array([int.from_bytes(k[:6], "little") + 0.5 for k in keys]) / 2**48)
        order = sorted(range(len(keys)), key=lambda i: (-levels[i], keys[i]))
        table, levels = table.take(order), levels[order]
        exact = _matrix(table["unit"], dim)
        graph = Graph(exact.astype(np.float32), levels)
        beam = audited_beam(graph, exact, threshold)
        links = [[graph.layers[l][i].tobytes() for l in range(level + 1)] for i, level in enumerate(levels)]
        n = len(order)
        return pa.table({
            "dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "node": pa.array(range(n), pa.int32()),
            "level": pa.array(levels, pa.int32()), "beam": pa.array([beam] * n, pa.int32()), "key": table["key"].cast(pa.binary()),
            "rep": table["rep"], "m": table["m"], "unit": table["unit"].cast(pa.binary()), "links": pa.array(links, pa.list_(pa.binary()))})

    return build


def roots(parent: np.ndarray, items: np.ndarray) -> np.ndarray:
    found = parent[items]
    while (parent[found] != found).any():
        found = parent[found]
    return found


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = roots(parent, a), roots(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _query(threshold: float):
    def query(nodes: pa.Table, asking: pa.Table) -> pa.Table:
        empty = {"key": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        if not nodes.num_rows or not asking.num_rows:
            return pa.table(empty)
        dim = nodes["dim"][0].as_py()
        nodes = nodes.sort_by("node")
        exact, queries = _matrix(nodes["unit"], dim), _matrix(asking["unit"], dim)
        levels, links = nodes["level"].to_numpy(), nodes["links"].to_pylist()
        layers = []
        for l in range(int(levels.max()) + 1):
            flat = np.frombuffer(b"".join(links[i][l] for i in range(int((levels >= l).sum()))), np.int32)
            layers.append(flat.reshape(int((levels >= l).sum()), -1))
        graph = Graph(exact.astype(np.float32), levels, layers)
        own = {k: i for i, k in enumerate(nodes["key"].to_pylist())}
        keys = asking["key"].to_pylist()
        self_at = np.array([own.get(k, -1) for k in keys])
        size, count = nodes["m"].to_numpy(), np.zeros(len(keys), np.int64)
        parent = np.arange(len(exact) + len(keys))
        for q, node in links_of(graph, exact, queries, nodes["beam"][0].as_py(), threshold):
            np.add.at(count, q, np.where(self_at[q] == node, 0, size[node]))
            unite(parent, q + len(exact), node.astype(np.int64))
        reps = np.concatenate([nodes["rep"].to_numpy(), asking["rep"].to_numpy()])
        top = roots(parent, np.arange(len(parent)))
        edge = reps != reps[top]
        linked = np.flatnonzero(count)
        none = [None] * int(edge.sum())
        return pa.table({
            "key": pa.array([keys[i] for i in linked] + none, pa.binary()), "n": pa.array(count[linked].tolist() + none, pa.int64()),
            "a": pa.array([None] * len(linked) + reps[edge].tolist(), pa.int64()),
            "b": pa.array([None] * len(linked) + reps[top][edge].tolist(), pa.int64())})

    return query


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `df`: id, n_links, component_id, kept."""
    ship(df.sparkSession)
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = stored(vectors.mapInArrow(_units, "id long, dim int, key binary, unit binary"), "units")
    classes = stored(rows.filter("key is not null").groupBy("key", "dim").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.any_value("unit").alias("unit")), "classes")
    total = classes.count()
    shards = max(1, min(SHARDS, math.ceil(total / 256)), math.ceil(total / SHARD_ROWS))
    blocks = max(1, math.ceil(total / BLOCK_ROWS))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    index = stored(dealt.groupBy("dim", "shard").applyInArrow(_build(threshold), NODES), "index")

    asking = classes.select("key", "rep", "dim", "unit", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
                            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    nodes = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["dim", "shard", "block"]
    found = stored(nodes.groupBy(*by).cogroup(asking.groupBy(*by)).applyInArrow(_query(threshold), FOUND), "found")

    mixed = rows.filter("key is not null").select("id", "key").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    bridges = rows.select("id", "key").join(mixed.select("id"), "id").join(classes.select("key", "rep"), "key").select(
        F.col("id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(found.filter("a is not null").select("a", "b").unionByName(bridges))
    counts = found.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    told = classes.select("key", "rep", "m").join(counts, "key", "left").join(components, F.col("rep") == F.col("node"), "left") \
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "key").join(told, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
