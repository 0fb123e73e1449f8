"""Hierarchical navigable small-world graphs over unit vectors, searched for many queries at once.

Nodes are numbered by falling level, so a layer's nodes are the first few. Every step of a search is done for all queries
together: each expands the best node of its beam that it has not expanded.
"""

from __future__ import annotations

import numpy as np

from ._hash import mix, uniform

#: Nearest vectors by which recall is measured where no vector is in range.
NEAREST = 10
#: Neighbours in upper layers and in the lowest, beam while building, nodes inserted at a time, queries searched at a time.
DEGREE, DEGREE_0, BUILD_BEAM, INSERTED, QUERIES = 12, 24, 48, 256, 512

#: Cosines with all vectors that are held at a time.
COSINES = 1 << 22


class Graph:
    def __init__(self, vectors: np.ndarray):
        """vectors: unit vectors in double precision, one a row."""
        n = len(vectors)
        level = np.minimum((-np.log(uniform(mix(np.arange(n, dtype=np.uint64)))) / np.log(DEGREE)).astype(int), 6)
        #: Row of `vectors` of each node.
        self.order = np.argsort(-level, kind="stable")
        level = level[self.order]
        self.exact = vectors[self.order]
        self.vectors = self.exact.astype(np.float32)
        self.sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)] if n else []
        self.links = [np.full((size, DEGREE if k else DEGREE_0), -1, np.int32) for k, size in enumerate(self.sizes)]
        done = min(n, 1)
        while done < n:
            upto = min(n, done + min(INSERTED, done))
            self._insert(done, upto)
            done = upto

    def _insert(self, a: int, b: int) -> None:
        new = np.arange(a, b)
        q = self.vectors[a:b]
        entry = np.zeros((b - a, 1), np.int32)
        mates = q @ q.T
        np.fill_diagonal(mates, -np.inf)
        for layer in reversed(range(len(self.sizes))):
            own = new < self.sizes[layer]
            ids, sims = self._beam(layer, q, entry, BUILD_BEAM if own.any() else 4, a)
            entry = ids[:, :4].copy()
            if own.any():
                cand = np.concatenate([ids[own], np.where(own[None, :], new[None, :], -1).repeat(own.sum(), 0).astype(np.int32)], 1)
                sim = np.concatenate([sims[own], np.where(own[None, :], mates[own], -np.inf)], 1)
                top = np.argsort(-sim, axis=1, kind="stable")[:, :BUILD_BEAM]
                self._link(layer, new[own], np.take_along_axis(cand, top, 1), np.take_along_axis(sim, top, 1))

    def _pick(self, cand: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
        """Of each row's candidates (best first) those that are nearer to the row's node than to one picked before; then the nearest of the others."""
        rows, many = cand.shape
        v = self.vectors[np.maximum(cand, 0)]
        among = v @ v.transpose(0, 2, 1)
        ok = (cand >= 0) & np.isfinite(sim)
        picked = np.zeros((rows, many), bool)
        for k in range(many):
            near = np.where(picked, among[:, k], -np.inf).max(1)
            picked[:, k] = ok[:, k] & (sim[:, k] > near) & (picked.sum(1) < degree)
        place = np.argsort(np.where(picked, 0, np.where(ok, 1, 2)), axis=1, kind="stable")[:, :degree]
        out = np.where(np.take_along_axis(ok, place, 1), np.take_along_axis(cand, place, 1), -1)
        return np.pad(out, ((0, 0), (0, max(0, degree - out.shape[1]))), constant_values=-1)

    def _link(self, layer: int, nodes: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> None:
        links = self.links[layer]
        degree = links.shape[1]
        links[nodes] = self._pick(cand, sim, degree)
        to = links[nodes].reshape(-1)
        of = np.repeat(nodes, degree)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        target, start, many = np.unique(to, return_index=True, return_counts=True)
        wide = np.full((len(target), int(many.max(initial=0))), -1, np.int32)
        wide[np.repeat(np.arange(len(target)), many), np.arange(len(to)) - np.repeat(start, many)] = of
        old = links[target]
        wide = np.where((wide[:, :, None] == old[:, None, :]).any(2), -1, wide)
        both = np.concatenate([old, wide], 1)
        for k in range(0, len(target), 256):
            t, c = target[k : k + 256], both[k : k + 256]
            s = np.where(c >= 0, np.einsum("ijk,ik->ij", self.vectors[np.maximum(c, 0)], self.vectors[t]), -np.inf)
            best = np.argsort(-s, axis=1, kind="stable")
            links[t] = self._pick(np.take_along_axis(c, best, 1), np.take_along_axis(s, best, 1), degree)

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, width: int, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of each query's beam, best first."""
        links, n = self.links[layer], len(q)
        size = min(len(links), size or len(links))
        ids = np.full((n, width), -1, np.int32)
        sims = np.full((n, width), -np.inf, np.float32)
        done = np.zeros((n, width), bool)
        seen = np.zeros((n, size), bool)
        entry = entry[:, : min(width, entry.shape[1])]
        k = entry.shape[1]
        rows = np.arange(n)
        ids[:, :k] = entry
        sims[:, :k] = np.where(entry >= 0, np.einsum("ijk,ik->ij", self.vectors[np.maximum(entry, 0)], q), -np.inf)
        for j in range(k):
            seen[rows[entry[:, j] >= 0], entry[entry[:, j] >= 0, j]] = True
        while True:
            open_sims = np.where(done[rows] | (ids[rows] < 0), -np.inf, sims[rows])
            best = open_sims.argmax(1)
            go = open_sims[np.arange(len(rows)), best] > -np.inf
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            done[rows, best] = True
            near = links[ids[rows, best]]
            new = (near >= 0) & (near < size)
            safe = np.where(new, near, 0)
            new &= ~seen[rows[:, None], safe]
            r, c = np.nonzero(new)
            seen[rows[r], near[r, c]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.vectors[near[r, c]], q[rows[r]])
            better = (s > sims[rows].min(1)[:, None]).any(1)
            if better.any():
                w = rows[better]
                all_ids = np.concatenate([ids[w], np.where(new, near, -1)[better]], 1)
                all_sims = np.concatenate([sims[w], s[better]], 1)
                all_done = np.concatenate([done[w], np.zeros_like(new[better])], 1)
                top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
                ids[w], sims[w], done[w] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def near(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(q), 1), np.int32)
        for layer in reversed(range(1, len(self.sizes))):
            entry = self._beam(layer, q, entry, 4)[0]
        return self._beam(0, q, entry, width)

    def within(self, queries: np.ndarray, least: float, width: int = 32, widest: int = 256, audit: int = 16, recall: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row of the vectors) with a cosine of at least `least`, verified in double precision.

        Queries whose whole beam is within the range are searched with wider beams, and beyond the widest compared with all
        vectors. One query in `audit` is compared with all in any case: while less than `recall` of what that finds is found, all
        beams are widened. What an audit finds is the pairs in range, without the query itself, or where there are none the
        NEAREST nearest vectors, so that recall is always measured.
        """
        found_q, found_v = [], []
        for k in range(0, len(queries), QUERIES):
            q = queries[k : k + QUERIES]
            checked = np.arange(0, len(q), audit)
            true_q, true_v = self._audited(q[checked], least)
            in_range = bool(len(true_q))
            if not in_range:
                true_q, true_v = self._nearest(q[checked])
            while True:
                a, b = self._widened(q, least, width, widest)
                if width > widest or not len(true_q):
                    break
                if in_range:
                    of = np.isin(a, checked)
                    key = a[of].astype(np.int64) * len(self.exact) + b[of]
                else:
                    ids, _ = self.near(q[checked].astype(np.float32), min(width, len(self.exact)))
                    key = (checked[:, None].astype(np.int64) * len(self.exact) + ids)[ids >= 0]
                if np.isin(checked[true_q].astype(np.int64) * len(self.exact) + true_v, key).mean() >= recall:
                    break
                width *= 2
            found_q.append(a + k)
            found_v.append(b)
        return np.concatenate([np.zeros(0, np.int64), *found_q]), self.order[np.concatenate([np.zeros(0, np.int64), *found_v])]

    def _all(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, COSINES // max(1, len(self.exact)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(q), step):
            a, b = np.nonzero(q[k : k + step] @ self.exact.T >= least)
            found.append((a + k, b))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _audited(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in range of vectors that are not equal."""
        cosine = q @ self.exact.T
        return np.nonzero((cosine >= least) & (cosine < 1 - 1e-12))

    def _nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's NEAREST nearest vectors."""
        many = min(NEAREST, len(self.exact))
        top = np.argpartition(-(q @ self.exact.T), many - 1, axis=1)[:, :many] if many else np.zeros((len(q), 0), np.int64)
        return np.repeat(np.arange(len(q)), many), top.reshape(-1)

    def _widened(self, q: np.ndarray, least: float, width: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
        open_, out_q, out_v = np.arange(len(q)), [], []
        while len(open_):
            if width > min(widest, len(self.exact) // 2):
                a, b = self._all(q[open_], least)
                out_q.append(open_[a])
                out_v.append(b)
                break
            ids, sims = self.near(q[open_].astype(np.float32), width)
            full = (ids[:, -1] >= 0) & (sims[:, -1] >= least - 1e-3)
            a, c = np.nonzero((ids >= 0) & (sims >= least - 1e-3) & ~full[:, None])
            v = ids[a, c]
            sure = np.einsum("ij,ij->i", self.exact[v], q[open_[a]]) >= least
            out_q.append(open_[a[sure]])
            out_v.append(v[sure].astype(np.int64))
            open_, width = open_[full], width * 4
        return np.concatenate([np.zeros(0, np.int64), *out_q]), np.concatenate([np.zeros(0, np.int64), *out_v])

    def dump(self) -> list[np.ndarray]:
        return [self.order, self.exact, *self.links]

    @classmethod
    def loaded(cls, order: np.ndarray, exact: np.ndarray, links: list[np.ndarray]) -> Graph:
        self = cls.__new__(cls)
        self.order, self.exact, self.links = order, exact, links
        self.vectors, self.sizes = exact.astype(np.float32), [len(x) for x in links]
        return self
