"""A hierarchical navigable small-world graph over unit vectors, on whole batches.

Nodes are renumbered by descending level, so every layer is a prefix. A layer's graph is an
array of neighbour numbers, padded with -1. Inserting and searching take many vectors at
once: each step expands the best few nodes of every beam with a few array operations.
"""

from __future__ import annotations

import numpy as np

LINKS = 16
BUILD_BEAM = 48
BATCH = 256
EXPAND = 4


class Graph:
    """`vectors`: unit rows, float32; `levels`: a level per row, in descending order."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, layers: list[np.ndarray] | None = None) -> None:
        self.vectors, self.layers = vectors, layers or []
        if layers is None:
            counts = [int((levels >= l).sum()) for l in range(int(levels.max(initial=0)) + 1)]
            self.layers = [np.zeros((0, 0), np.int32)] * len(counts)
            for layer in reversed(range(len(counts))):
                self._build(layer, counts[layer])

    def _build(self, layer: int, count: int) -> None:
        degree = LINKS * 2 if layer == 0 else LINKS
        links = np.full((count, degree), -1, np.int32)
        self.layers[layer] = links
        first = min(count, BATCH)
        self._connect(links, np.arange(first), *self._all_pairs(0, first, first), 0)
        for start in range(first, count, BATCH):
            new = np.arange(start, min(count, start + BATCH))
            ids, sims = self.search(self.vectors[new], BUILD_BEAM, layer)
            own_ids, own_sims = self._all_pairs(start, len(new), BUILD_BEAM // 2)
            self._connect(links, new, np.hstack([ids, own_ids]), np.hstack([sims, own_sims]), start)

    def _all_pairs(self, start: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        block = self.vectors[start:start + n]
        sims = block @ block.T
        np.fill_diagonal(sims, -np.inf)
        most = min(most, n, BUILD_BEAM)
        ids = np.argpartition(-sims, most - 1, axis=1)[:, :most] if n else np.zeros((0, 0), int)
        sims = np.take_along_axis(sims, ids, 1)
        return np.where(sims == -np.inf, -1, ids + start).astype(np.int32), sims

    def _select(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to neighbours chosen before them;
        places left over go to the nearest others."""
        order = np.argsort(-np.where(ids < 0, -np.inf, sims), axis=1, kind="stable")[:, :BUILD_BEAM + degree]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        rows, width = ids.shape
        chosen, closest = np.zeros((rows, width), bool), np.full((rows, width), -np.inf, np.float32)
        around = self.vectors[ids]
        between = np.matmul(around, around.transpose(0, 2, 1))
        for c in range(width):
            take = (ids[:, c] >= 0) & (closest[:, c] < sims[:, c]) & (chosen.sum(1) < degree)
            chosen[:, c] = take
            closest[take] = np.maximum(closest[take], between[take, c])
        rank = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :degree]
        out = np.take_along_axis(ids, rank, 1)
        return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)

    def _connect(self, links: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, start: int) -> None:
        degree = links.shape[1]
        half = max(1, degree // 2)
        if not len(new) or not ids.shape[1]:
            return
        forward = self._select(ids, sims, half)
        links[new, :half] = forward
        source, target = np.repeat(new, half), forward.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, begin, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begin, count)
        most = int(count.max(initial=0))
        back = np.full((len(hit), most), -1, np.int32)
        back[np.repeat(np.arange(len(hit)), count), place] = source
        for a in range(0, len(hit), BATCH):
            nodes = hit[a:a + BATCH]
            both = np.sort(np.hstack([links[nodes], back[a:a + BATCH]]), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            if both.shape[1] > 4 * BUILD_BEAM:
                sims = np.where(both < 0, -np.inf, np.einsum("nkd,nd->nk", self.vectors[both], self.vectors[nodes]))
                near = np.argpartition(-sims, 4 * BUILD_BEAM, axis=1)[:, :4 * BUILD_BEAM]
                both = np.take_along_axis(both, near, 1)
            sims = np.einsum("nkd,nd->nk", self.vectors[both], self.vectors[nodes])
            few = (both >= 0).sum(1) <= degree
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
            packed = np.pad(packed, ((0, 0), (0, degree - packed.shape[1])), constant_values=-1)
            if not few.all():
                packed[~few] = self._select(both[~few], sims[~few], degree)
            links[nodes] = packed

    def search(self, queries: np.ndarray, beam: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the `beam` best nodes found, unordered; -1 pads."""
        entry = np.zeros(len(queries), np.int32)
        for upper in range(len(self.layers) - 1, layer, -1):
            entry = self._descend(queries, entry, self.layers[upper])
        links = self.layers[layer]
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(links) + 1), bool)
        seen[:, -1] = True  # where padding points
        ids = np.full((len(queries), beam), -1, np.int32)
        sims = np.full((len(queries), beam), -np.inf, np.float32)
        done = np.ones((len(queries), beam), bool)
        ids[:, 0], done[:, 0] = entry, False
        sims[:, 0] = np.einsum("nd,nd->n", self.vectors[entry], queries)
        seen[rows[:, 0], entry] = True
        live = np.arange(len(queries))
        expand = min(EXPAND, beam)
        while len(live):
            waiting = np.where(done[live], -np.inf, sims[live])
            picked = np.argpartition(-waiting, expand - 1, axis=1)[:, :expand]
            usable = np.take_along_axis(waiting, picked, 1) > -np.inf
            going = usable.any(1)
            live, picked, usable = live[going], picked[going], usable[going]
            if not len(live):
                break
            done[live[:, None], picked] = True
            nodes = np.where(usable, ids[live[:, None], picked], 0)
            around = np.where(usable[:, :, None], links[nodes], -1).reshape(len(live), -1)
            around = np.sort(around, axis=1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            around = np.where(seen[live[:, None], around], -1, around)
            seen[live[:, None], around] = True
            near = np.matmul(self.vectors[around], queries[live][:, :, None])[:, :, 0]
            near[around < 0] = -np.inf
            all_sims = np.hstack([sims[live], near])
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, best, 1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], around]), best, 1)
            done[live] = np.take_along_axis(np.hstack([done[live], around < 0]), best, 1)
        return ids, sims

    def _descend(self, queries: np.ndarray, entry: np.ndarray, links: np.ndarray) -> np.ndarray:
        best = np.einsum("nd,nd->n", self.vectors[entry], queries)
        live = np.arange(len(queries))
        while len(live):
            around = links[entry[live]]
            near = np.matmul(self.vectors[around], queries[live][:, :, None])[:, :, 0]
            near[around < 0] = -np.inf
            top = near.argmax(1) if near.shape[1] else np.zeros(len(live), int)
            value = near[np.arange(len(live)), top] if near.shape[1] else np.full(len(live), -np.inf)
            better = value > best[live]
            entry[live[better]], best[live[better]] = around[better, top[better]], value[better]
            live = live[better]
        return entry


def levels_of(uniform: np.ndarray) -> np.ndarray:
    """Levels from uniform numbers, as if by coin tosses with odds 1 : LINKS - 1."""
    return np.floor(-np.log(np.maximum(uniform, 1e-18)) / np.log(LINKS)).astype(np.int32)
