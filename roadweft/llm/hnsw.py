"""Hierarchical navigable small-world graphs over unit vectors, searched for many queries at once.

Layers are built from the top down. Nodes join a layer in batches that at most double it: a batch
is searched in the graph so far, entering where the layer above leads, compared with itself in one
product, and linked to diverse near nodes both ways.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS = 12
BUILD_BEAM = 40
BATCH = 1024
FIRST = 64


def _pick(vectors: np.ndarray, base: np.ndarray, found: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """For each row of ``found`` (candidate nodes, -1 for none, nearest first) up to ``width``
    diverse ones: a candidate is passed over while it is nearer to one picked than to the base;
    places left go to the nearest passed over."""
    n, k = found.shape
    near = vectors[np.maximum(found, 0)]
    among = np.matmul(near, near.transpose(0, 2, 1))
    picked = np.zeros((n, k), bool)
    for c in range(k):
        rival = np.where(picked[:, :c], among[:, c, :c], -2.0).max(1) if c else np.full(n, -2.0)
        picked[:, c] = (found[:, c] >= 0) & (rival < sims[:, c]) & (picked.sum(1) < width)
    rank = np.where(picked, 0, np.where(found >= 0, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :width]
    return np.take_along_axis(found, order, 1)


@dataclass
class Layer:
    nodes: np.ndarray  # node numbers that the layer has
    links: np.ndarray  # (all nodes, width): neighbours, -1 for none


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), nearest first, of the best ``beam`` nodes met from the entry nodes
    (queries x any number, -1 for none). Expands every node that stays in the beam."""
    n = len(queries)
    width = max(beam, entries.shape[1])
    ids = np.full((n, width), -1, np.int32)
    sims = np.full((n, width), -2.0, np.float32)
    ids[:, : entries.shape[1]] = entries
    sims[:, : entries.shape[1]] = np.where(entries >= 0, np.einsum("qd,qed->qe", queries, vectors[np.maximum(entries, 0)]), -2.0)
    done = ids < 0
    active = np.arange(n)
    while len(active):
        open_ = np.where(done[active], -2.0, sims[active])
        best = open_.argmax(1)
        more = np.take_along_axis(open_, best[:, None], 1)[:, 0] > -2.0
        active, best = active[more], best[more]
        if not len(active):
            break
        done[active, best] = True
        around = links[ids[active, best]]
        known = (around[:, :, None] == ids[active][:, None, :]).any(2) | (around < 0)
        near = np.einsum("qd,qed->qe", queries[active], vectors[np.maximum(around, 0)])
        near[known] = -2.0
        all_sims = np.concatenate([sims[active], near], 1)
        all_ids = np.concatenate([ids[active], np.where(known, -1, around)], 1)
        all_done = np.concatenate([done[active], known], 1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        ids[active] = np.take_along_axis(all_ids, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(-sims, axis=1)[:, :beam]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Index:
    """The graph of one shard. ``vectors``: unit rows in float32."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer]) -> None:
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1, links: int = LINKS, beam: int = BUILD_BEAM) -> "Index":
        rng = np.random.default_rng(seed)
        n = len(vectors)
        level = np.floor(-np.log(1.0 - rng.random(n)) / np.log(links)).astype(int)
        index = cls(vectors, [])
        for at in range(int(level.max(initial=0)), -1, -1):
            members = np.flatnonzero(level >= at)
            members = members[np.lexsort((rng.random(len(members)), -level[members]))]  # those of the layer above first
            index.layers.append(index._layer(members, links * (2 if at == 0 else 1), beam))
        return index

    def _layer(self, members: np.ndarray, width: int, beam: int) -> Layer:
        x = self.vectors
        layer = Layer(members, np.full((len(x), width), -1, np.int32))
        done = 0
        inside = np.zeros(len(x), bool)  # nodes that the layer has so far
        while done < len(members):
            batch = members[done : done + (FIRST if not done else min(BATCH, done))]
            within = x[batch] @ x[batch].T
            np.fill_diagonal(within, -2.0)
            k = min(beam, len(batch))
            top = np.argpartition(-within, k - 1, axis=1)[:, :k]
            ids, sims = batch[top].astype(np.int32), np.take_along_axis(within, top, 1)
            if done:
                before = members[:done]
                entries = self.entries(x[batch]) if self.layers else np.full((len(batch), 1), before[0], np.int32)
                entries = np.where((entries >= 0) & inside[entries], entries, -1)
                entries[(entries < 0).all(1), 0] = before[0]
                found, near = beam_search(x, layer.links, x[batch], entries, beam)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, near], 1)
            ids = np.where(sims > -1.5, ids, -1)
            order = np.argsort(-sims, axis=1)[:, :beam]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            chosen = _pick(x, x[batch], ids, sims, width)
            layer.links[batch, : chosen.shape[1]] = chosen
            self._back(layer, batch, chosen, width)
            inside[batch] = True
            done += len(batch)
        return layer

    def _back(self, layer: Layer, batch: np.ndarray, chosen: np.ndarray, width: int) -> None:
        """Link the chosen nodes back; where too many come, the diverse near ones stay."""
        x = self.vectors
        source = np.repeat(batch, chosen.shape[1])
        target = chosen.ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        old = layer.links[nodes]
        new = np.full((len(nodes), int(counts.max(initial=0))), -1, np.int32)
        row = np.repeat(np.arange(len(nodes)), counts)
        new[row, np.arange(len(source)) - np.repeat(first, counts)] = source
        new[(new[:, :, None] == old[:, None, :]).any(2)] = -1
        ids = np.concatenate([old, new], 1)
        # few rows at a time: popular nodes can be chosen by a whole batch
        for a in range(0, len(nodes), 256):
            part = ids[a : a + 256]
            part = part[:, (part >= 0).any(0)]
            sims = np.where(part >= 0, np.einsum("nd,nkd->nk", x[nodes[a : a + 256]], x[np.maximum(part, 0)]), -2.0)
            order = np.argsort(-sims, axis=1)[:, : 2 * width]
            best, near = np.take_along_axis(part, order, 1), np.take_along_axis(sims, order, 1)
            kept = _pick(x, x[nodes[a : a + 256]], best, near, width)
            full = np.full((len(part), width), -1, np.int32)
            full[:, : kept.shape[1]] = kept
            layer.links[nodes[a : a + 256]] = full

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Where the layers so far lead: the nearest nodes of the lowest one."""
        at = np.full((len(queries), 1), self.layers[0].nodes[0], np.int32)
        for layer in self.layers:
            at, _ = beam_search(self.vectors, layer.links, queries, at, 2)
        return at

    def search(self, queries: np.ndarray, beam: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of the best ``beam`` nodes of each query, nearest first."""
        parts = []
        for a in range(0, len(queries), block):
            q = queries[a : a + block]
            at = np.full((len(q), 1), self.layers[0].nodes[0], np.int32)
            for layer in self.layers[:-1]:
                at, _ = beam_search(self.vectors, layer.links, q, at, 2)
            parts.append(beam_search(self.vectors, self.layers[-1].links, q, at, beam))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
