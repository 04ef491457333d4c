"""Hierarchical navigable small-world graphs in numpy.

Nodes are inserted in batches, and all queries of a block walk the graph in lock-step, so every step is a handful of array
operations over the whole block instead of a heap operation per node.
"""

from __future__ import annotations

import io

import numpy as np


def _top(ids: np.ndarray, sims: np.ndarray, done: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (ids, sims, done))


def _diverse(ids: np.ndarray, sims: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none), up to ``most`` that are nearer to the row's node than to one chosen
    before; the best of the others fill what is left."""
    rows, n = ids.shape
    v = x[np.maximum(ids, 0)]
    between = np.einsum("bcd,bed->bce", v, v)
    chosen = np.zeros((rows, n), dtype=bool)
    nearest = np.full((rows, n), -2.0, dtype=np.float32)
    for k in range(n):
        take = (ids[:, k] >= 0) & (sims[:, k] > nearest[:, k]) & (chosen.sum(axis=1) < most)
        chosen[:, k] = take
        nearest = np.where(take[:, None], np.maximum(nearest, between[:, k, :]), nearest)
    rank = np.where(ids >= 0, np.where(chosen, 0, 1) * n + np.arange(n), 3 * n)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, axis=1)


class Layer:
    def __init__(self, n: int, width: int):
        self.width = width
        self.links = np.full((n, width), -1, dtype=np.int32)

    def walk(self, x: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query (ids, similarities), best first. ``entry``: (queries, any) ids, -1 where none."""
        ids = np.full((len(q), ef), -1, dtype=np.int32)
        sims = np.full((len(q), ef), -2.0, dtype=np.float32)
        k = min(ef, entry.shape[1])
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qed,qd->qe", x[np.maximum(ids[:, :k], 0)], q), -2.0)
        done = ids < 0
        ids, sims, done = _top(ids, sims, done, ef)
        live = np.flatnonzero(~done.all(axis=1))
        while len(live):
            i, s, f = ids[live], sims[live], done[live]
            at = np.argmin(f, axis=1)  # the best one that is not expanded
            row = np.arange(len(live))
            f[row, at] = True
            new = self.links[i[row, at]]
            again = np.tril(new[:, :, None] == new[:, None, :], -1).any(axis=2)
            new = np.where(again | (new[:, :, None] == i[:, None, :]).any(axis=2), -1, new)
            near = np.where(new >= 0, np.einsum("qmd,qd->qm", x[np.maximum(new, 0)], q[live]), -2.0)
            ids[live], sims[live], done[live] = _top(
                np.concatenate([i, new], axis=1), np.concatenate([s, near.astype(np.float32)], axis=1), np.concatenate([f, new < 0], axis=1), ef
            )
            live = live[~done[live].all(axis=1)]
        return ids, sims

    def insert(self, x: np.ndarray, new: np.ndarray, found: np.ndarray, sims: np.ndarray) -> None:
        """Link ``new`` nodes with candidates (best first), and those back."""
        forth = _diverse(found, sims, x, max(2, self.width // 2))
        self.links[new, : forth.shape[1]] = forth
        target, source = forth.ravel(), np.repeat(new, forth.shape[1])
        fresh = (target >= 0) & ~(self.links[target] == source[:, None]).any(axis=1)
        source, target = source[fresh], target[fresh]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        which, first, count = np.unique(target, return_index=True, return_counts=True)
        have = (self.links[which] >= 0).sum(axis=1)
        easy = have + count <= self.width
        for k in range(int(count.max()) if len(count) else 0):
            at = np.flatnonzero(easy & (count > k))
            self.links[which[at], have[at] + k] = source[first[at] + k]
        full = np.flatnonzero(~easy)
        for part in np.array_split(full, max(1, len(full) // 128)):
            if len(part):
                extra = int(min(count[part].max(), 2 * self.width))
                grid = np.full((len(part), extra), -1, dtype=np.int32)
                for k in range(extra):
                    some = count[part] > k
                    grid[some, k] = source[first[part[some]] + k]
                ids = np.concatenate([self.links[which[part]], grid], axis=1)
                near = np.where(ids >= 0, np.einsum("bcd,bd->bc", x[np.maximum(ids, 0)], x[which[part]]), -2.0).astype(np.float32)
                ids, near, _ = _top(ids, near, ids < 0, ids.shape[1])
                self.links[which[part]] = _diverse(ids, near, x, self.width)


class Index:
    """A graph over unit vectors: ``layers`` from the top down, nodes ordered so that each layer holds the first ``sizes``."""

    def __init__(self, x: np.ndarray, level: np.ndarray, width: int = 16, ef: int = 40):
        self.order = np.argsort(-level, kind="stable")
        self.x = np.ascontiguousarray(x[self.order], dtype=np.float32)
        top = int(level.max()) if len(level) else 0
        self.sizes = [int((level >= k).sum()) for k in range(top, -1, -1)]
        self.layers: list[Layer] = []
        for size in self.sizes:
            self.layers.append(self._build(size, width * 2 if size == len(x) else width, ef))

    def _build(self, size: int, width: int, ef: int) -> Layer:
        layer, done = Layer(size, width), min(size, 256)
        if done > 1:
            sims = self.x[:done] @ self.x[:done].T
            np.fill_diagonal(sims, -2)
            ids = np.argsort(-sims, axis=1, kind="stable")[:, : min(ef, done - 1)].astype(np.int32)
            layer.insert(self.x, np.arange(done), ids, np.take_along_axis(sims, ids, axis=1))
        while done < size:
            new = np.arange(done, min(size, done + min(512, done)))
            q = self.x[new]
            ids, sims = layer.walk(self.x, q, self._entry(q, done), ef)
            among = q @ q.T
            np.fill_diagonal(among, -2)
            k = min(16, len(new) - 1)
            near = np.argsort(-among, axis=1, kind="stable")[:, :k]
            ids, sims, _ = _top(
                np.concatenate([ids, new[near].astype(np.int32)], axis=1), np.concatenate([sims, np.take_along_axis(among, near, axis=1)], axis=1),
                np.zeros((len(new), ef + k), dtype=bool), ef,
            )
            layer.insert(self.x, new, ids, sims)
            done = int(new[-1]) + 1
        return layer

    def _entry(self, q: np.ndarray, least: int | None = None, ef: int = 8) -> np.ndarray:
        """Where to enter the layer below those that are built."""
        entry = np.zeros((len(q), 1), dtype=np.int32)
        for layer in self.layers[: len(self.layers) if least is not None else -1]:
            entry, _ = layer.walk(self.x, q, entry, ef)
        return entry

    def near(self, q: np.ndarray, least: float, ef: int, block: int = 512) -> list[np.ndarray]:
        """For each query, nodes (original numbers) found with similarity >= least: the beam, and for beams that end inside
        the ball whatever the links of what is found reach inside it."""
        out = []
        for k in range(0, len(q), block):
            part = np.ascontiguousarray(q[k : k + block], dtype=np.float32)
            ids, sims = self.layers[-1].walk(self.x, part, self._entry(part), min(ef, max(1, self.sizes[-1])))
            for row, (i, s) in enumerate(zip(ids, sims, strict=True)):
                hits = np.unique(i[(s >= least) & (i >= 0)])
                if len(hits) > 3:
                    hits = self._flood(part[row], hits, least)
                out.append(self.order[hits])
        return out

    def _flood(self, q: np.ndarray, hits: np.ndarray, least: float) -> np.ndarray:
        seen = np.zeros(self.sizes[-1], dtype=bool)
        seen[hits] = True
        found, front = [hits], hits
        while len(front):
            new = self.layers[-1].links[front].ravel()
            new = np.unique(new[new >= 0])
            new = new[~seen[new]]
            seen[new] = True
            front = new[self.x[new] @ q >= least]
            found.append(front)
        return np.concatenate(found)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, order=self.order, x=self.x, sizes=np.array(self.sizes), **{f"l{k}": layer.links for k, layer in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        self, z = cls.__new__(cls), np.load(io.BytesIO(data))
        self.order, self.x, self.sizes, self.layers = z["order"], z["x"], z["sizes"].tolist(), []
        for k in range(len(self.sizes)):
            layer = Layer.__new__(Layer)
            layer.links = z[f"l{k}"]
            layer.width = layer.links.shape[1]
            self.layers.append(layer)
        return self
