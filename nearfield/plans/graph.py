"""The proximity graph of one shard, as arrays: build, search, check.

Nodes are rows of a matrix in ascending id. Three builds: "batch" takes each
row's exact neighbours from blocked matrix products and prunes them for all
rows at once; "doubling" links ever larger batches to the graph of the rows
before them; "serial" inserts one row after the other: it searches the graph
built so far, and the visited nodes become edges both ways under two rules: an
edge is refused if an existing neighbour is much nearer to its end (alpha), and
a full node gives up its farthest edge. Everything is ordered by (distance,
row), so one input gives one graph. Of equal vectors one is linked and the
others hang on it as a chain.
"""

from __future__ import annotations

import heapq

import numpy as np

from ..config import IndexConfig, Metric
from ..functions.codes import EdgeCodes

NONE = -1
#: Rows whose distances to all others, or whose candidates' distances to each other, are held at a time.
ROWS_AT_ONCE, PRUNED_AT_ONCE = 512, 256
#: Queries whose distances to all rows of a shard are held at a time.
COMPLETED_AT_ONCE = 64
#: A row in so many stands for a coarser level, whose rows are linked among themselves too.
LEVEL, LEVEL_EDGES = 8, 8
FIRST_BATCH = 256


class Graph:
    """vectors (n x d), ids (n), neighbours (n x r, NONE-padded) and their distances; entry is the node nearest to the mean."""

    def __init__(self, config: IndexConfig, ids: np.ndarray, vectors: np.ndarray):
        self.config = config
        order = np.argsort(ids, kind="stable")
        self.ids = np.asarray(ids, np.int64)[order]
        self.x = np.atleast_2d(np.asarray(vectors, np.float64))[order] if len(order) else np.zeros((0, 1))
        n = len(self.ids)
        self.near = np.full((n, config.r), NONE, np.int32)
        self.dist = np.full((n, config.r), np.inf)
        self.count = np.zeros(n, np.int32)
        self.visits = 0
        norms = np.sqrt((self.x**2).sum(1))
        self.zero = norms == 0
        self.unit = self.x / np.where(self.zero, 1, norms)[:, None] if config.metric is Metric.COSINE else self.x
        self.codes = EdgeCodes.of(config.edge_type, self.x, config.metric) if n else None
        self.entry = self._medoid() if n else NONE

    def _medoid(self) -> int:
        """The row nearest to the mean; for inner products the one of largest norm."""
        if self.config.metric is Metric.IP:
            return int((self.x**2).sum(1).argmax())
        return int(((self.unit - self.unit.mean(0)) ** 2).sum(1).argmin())

    def prepared(self, q: np.ndarray) -> np.ndarray:
        q = np.asarray(q, np.float64)
        if self.config.metric is Metric.COSINE:
            norm = float(np.sqrt((q**2).sum()))
            return q / norm if norm else q * 0
        return q

    def measure(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact distances of a prepared query to rows."""
        x = self.unit[rows]
        if self.config.metric is Metric.L2:
            d = x - q
            return np.sqrt(np.einsum("ij,ij->i", d, d))
        dot = x @ q
        if self.config.metric is Metric.IP:
            return -dot
        return np.where(self.zero[rows] | (not q.any()), 1.0, 1 - np.clip(dot, -1, 1))

    def search(self, query: np.ndarray, k: int, breadth: int, limit: int | None = None, allowed: np.ndarray | None = None, gamma: float = 1.0) -> list[tuple[float, int]]:
        """(distance, row) of up to k nearest rows found by a beam of max(breadth, k), nearest first.

        limit: only rows below it are in the graph yet. allowed (booleans): any
        node may be crossed but only allowed ones are results; the walk ends
        when the beam's best is beyond gamma times the worst of k results.
        With edge codes, the beam is ordered by codes, and results by the
        vectors of all nodes met, not just of those the beam visits.
        """
        n = len(self.ids) if limit is None else limit
        if not n:
            return []
        breadth = max(breadth, k)
        q = self.prepared(query)
        coded = self.codes is not None
        guess = self.codes.measure(query) if coded else lambda rows: self.measure(q, rows)

        seen = np.zeros(len(self.ids), bool)
        start = np.array([self.entry if self.entry < n else 0])
        seen[start] = True
        first = float(guess(start)[0])
        beam = [(first, int(start[0]))]  # to visit, nearest first
        held = [(-first, -int(start[0]))]  # the best `breadth` met so far, farthest first
        best: list[tuple[float, int]] = []  # results, farthest first

        def met(rows: np.ndarray) -> None:
            rows = rows if allowed is None else rows[allowed[rows]]
            for exact, row in zip(self.measure(q, rows).tolist(), rows.tolist()):
                heapq.heappush(best, (-exact, -row))
                if len(best) > breadth:
                    heapq.heappop(best)

        if coded:
            met(start)
        while beam:
            d, row = heapq.heappop(beam)
            if len(held) >= breadth and (-d, -row) < held[0]:
                break
            if allowed is not None and len(best) >= k and not coded and d > -best[0][0] * gamma and len(held) >= breadth:
                break
            self.visits += 1
            if not coded and (allowed is None or allowed[row]):
                heapq.heappush(best, (-d, -row))
                if len(best) > max(k, breadth):
                    heapq.heappop(best)
            around = self.near[row, : self.count[row]]
            around = around[(around >= 0) & (around < n)]
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            if coded:
                met(around)
            for dn, other in zip(guess(around).tolist(), around.tolist()):
                if len(held) < breadth or (-dn, -other) > held[0]:
                    heapq.heappush(beam, (dn, other))
                    heapq.heappush(held, (-dn, -other))
                    if len(held) > breadth:
                        heapq.heappop(held)
        return sorted((-d, -row) for d, row in best)[:k]

    def complete(self, queries: np.ndarray, walked: list[list[tuple[float, int]]], k: int, digits: int, allowed: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """The true k nearest (rounded distance, row) of each query, ties to the lower row, from what its walk found.

        The walk's k-th distance bounds the true one, so only rows within it are
        ordered; after a walk that found fewer than k rows all of them are.
        """
        rows = np.arange(len(self.ids)) if allowed is None else np.flatnonzero(allowed)
        out: list[list[tuple[float, int]]] = []
        for a in range(0, len(queries), COMPLETED_AT_ONCE):
            q = np.stack([self.prepared(x) for x in queries[a : a + COMPLETED_AT_ONCE]])
            d = np.round(self._apart(q, rows), digits)
            edge = np.array([round(found[k - 1][0], digits) if len(found) >= k else np.inf for found in walked[a : a + len(q)]])
            at, place = np.nonzero(d <= edge[:, None] + 1.5 * 10.0**-digits)  # the walk's sums may round the other way
            order = np.lexsort((place, d[at, place], at))
            at, place = at[order], place[order]
            starts = np.searchsorted(at, np.arange(len(q) + 1)).tolist()
            for i, (b, e) in enumerate(zip(starts, starts[1:])):
                best = place[b : min(e, b + k)]
                out.append(list(zip(d[i, best].tolist(), rows[best].tolist())))
        return out

    def _apart(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact distances of prepared queries to rows, len(q) x len(rows)."""
        x = self.unit[rows]
        if self.config.metric is Metric.L2:
            return np.stack([self.measure(v, rows) for v in q])
        dot = q @ x.T
        if self.config.metric is Metric.IP:
            return -dot
        return np.where(self.zero[rows][None] | ~q.any(1)[:, None], 1.0, 1 - np.clip(dot, -1, 1))

    def _offer(self, node: int, new: int, d: float) -> None:
        """Adds an edge node -> new unless a neighbour covers it; a full node replaces its farthest edge if that is farther."""
        c = int(self.count[node])
        around = self.near[node, :c]
        if (around == new).any():
            return
        if c:
            between = self.measure(self.unit[new], around)
            if (self.config.alpha * between < d).any():
                return
        if c < self.config.r:
            at = c
            self.count[node] = c + 1
        else:
            at = int(np.lexsort((around, self.dist[node, :c]))[-1])
            if self.dist[node, at] <= d:
                return
        self.near[node, at], self.dist[node, at] = new, d
        # the new edge may cover others
        c = int(self.count[node])
        around = self.near[node, :c]
        between = self.measure(self.unit[new], around)
        keep = (around == new) | (self.config.alpha * between >= self.dist[node, :c])
        if not keep.all():
            m = int(keep.sum())
            self.near[node, :m], self.dist[node, :m] = around[keep], self.dist[node, :c][keep]
            self.near[node, m:c], self.dist[node, m:c] = NONE, np.inf
            self.count[node] = m

    def insert(self, row: int) -> None:
        """Links row to the graph of the rows before it."""
        if row == 0:
            return
        found = self.search(self.x[row], self.config.l_insert, self.config.l_insert, limit=row)
        for d, other in found:
            self._offer(row, other, d)
        for d, other in found:
            self._offer(other, row, d)
        if not self.count[row] and found:
            self._force(row, found[0][1], found[0][0])
        if found and not (self.near[self.near[row, : self.count[row]]] == row).any():
            self._force(found[0][1], row, found[0][0])

    def _force(self, node: int, new: int, d: float) -> None:
        """Adds an edge whatever the rules say, so that no node is cut off."""
        c = int(self.count[node])
        if c < self.config.r:
            self.near[node, c], self.dist[node, c] = new, d
            self.count[node] = c + 1
        else:
            at = int(np.argmax(self.dist[node]))
            self.near[node, at], self.dist[node, at] = new, d

    # --- builds

    def build(self) -> Graph:
        n = len(self.ids)
        if n > 1:
            kinds = np.unique(self.unit, axis=0, return_index=True, return_inverse=True)
            self._build(np.sort(kinds[1]))
            self._chain(kinds[1], kinds[2].ravel())
        return self.repair()

    def _build(self, rows: np.ndarray) -> None:
        """Links the given rows, whose vectors all differ."""
        if self.config.build == "serial":
            entry, self.entry = self.entry, 0  # the walk starts at the first row, which is always there
            for row in rows[rows > 0].tolist():
                self.insert(row)
            self.entry = entry
            return
        first = len(rows) if self.config.build == "batch" else min(FIRST_BATCH, len(rows))
        self._join(rows[:first])
        while first < len(rows):
            batch = rows[first : 2 * first]
            self._extend(batch, int(batch[0]))
            first += len(batch)

    def _join(self, rows: np.ndarray) -> None:
        """Exact neighbours among rows, and among ever fewer of them, so that far regions are linked too."""
        if len(rows) < 2:
            return
        far = min(LEVEL_EDGES, self.config.r // 4)  # places kept for edges of coarser levels
        near, dist = self._nearest(rows, rows, min(self.config.l_insert, len(rows) - 1))
        keep = self._pruned(rows, near, dist, max(1, self.config.r // 2))
        node = np.repeat(rows, near.shape[1])[keep.ravel()]
        self._add(np.append(node, near[keep]), np.append(near[keep], node), np.append(dist[keep], dist[keep]), self.config.r - far)
        if not far:
            return
        # ways into far regions: from coarser levels to their own neighbours, from the entry to the coarsest, and a few at random
        level = rows
        while len(level) > max(LEVEL, self.config.r // 2):
            level = np.unique(np.append(level[::LEVEL], self.entry))
            near, dist = self._nearest(level, level, min(max(1, far // 2), len(level) - 1))
            self._add(np.repeat(level, near.shape[1]), near.ravel(), dist.ravel())
        some = np.random.default_rng(len(rows)).choice(rows, (len(rows), max(1, far // 4)))
        node, other = np.append(np.repeat(rows, some.shape[1]), np.full(len(level), self.entry)), np.append(some.ravel(), level)
        self._add(node, other, self._between(node, other))

    def _extend(self, batch: np.ndarray, limit: int) -> None:
        """Links a batch to the graph of the rows below limit, which all of it searches as it was, and to itself."""
        found = [self.search(self.x[row], self.config.l_insert, self.config.l_insert, limit=limit) for row in batch.tolist()]
        node = np.repeat(batch, [len(f) for f in found])
        other = np.array([row for f in found for _, row in f], np.int64)
        dist = np.array([d for f in found for d, _ in f])
        if len(batch) > 1:
            near, own = self._nearest(batch, batch, min(self.config.l_insert, len(batch) - 1))
            node, other, dist = np.append(node, np.repeat(batch, near.shape[1])), np.append(other, near.ravel()), np.append(dist, own.ravel())
        self._add(node, other, dist)
        count = self.count[batch]
        back = np.repeat(batch, count)
        place = np.arange(self.config.r)[None] < count[:, None]
        self._add(self.near[batch][place], back, self.dist[batch][place])

    def _nearest(self, rows: np.ndarray, among: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The `most` nearest of `among` to each of rows but itself, with their distances, nearest first."""
        y = self.unit[among].astype(np.float32)
        square = (y**2).sum(1)
        near, dist = np.empty((len(rows), most), np.int64), np.empty((len(rows), most))
        for a in range(0, len(rows), ROWS_AT_ONCE):
            own = rows[a : a + ROWS_AT_ONCE]
            d = -(self.unit[own].astype(np.float32) @ y.T)
            if self.config.metric is Metric.L2:
                d = 2 * d + square[None]  # the order of distances to one row
            d[own[:, None] == among[None]] = np.inf
            pick = np.argpartition(d, most - 1, axis=1)[:, :most] if most < len(among) else np.tile(np.arange(len(among)), (len(own), 1))
            exact = self._between(own[:, None], among[pick])
            order = np.lexsort((among[pick], exact), axis=1)
            near[a : a + len(own)] = np.take_along_axis(among[pick], order, 1)
            dist[a : a + len(own)] = np.take_along_axis(exact, order, 1)
        return near, dist

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact distances of rows a to rows b, arrays of one shape or broadcast."""
        x, y = self.unit[a], self.unit[b]
        if self.config.metric is Metric.L2:
            return np.sqrt(((x - y) ** 2).sum(-1))
        dot = (x * y).sum(-1)
        if self.config.metric is Metric.IP:
            return -dot
        return np.where(self.zero[a] | self.zero[b], 1.0, 1 - np.clip(dot, -1, 1))

    def _pruned(self, nodes: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Which of each node's candidates (nearest first, NONE-padded) are kept: up to `most`, none that a kept one covers.

        A candidate is covered if alpha times its distance to a kept one is
        under its own; if under half of `most` are left, the nearest others fill up.
        """
        keep = np.zeros(near.shape, bool)
        alpha = self.config.alpha
        for a in range(0, len(nodes), PRUNED_AT_ONCE):
            c, d = near[a : a + PRUNED_AT_ONCE], dist[a : a + PRUNED_AT_ONCE]
            x = self.unit[c].astype(np.float32)
            dot = np.matmul(x, x.transpose(0, 2, 1))
            if self.config.metric is Metric.L2:
                square = np.einsum("ijj->ij", dot)
                between = np.sqrt(np.maximum(square[:, :, None] + square[:, None] - 2 * dot, 0))
            else:
                between = -dot if self.config.metric is Metric.IP else 1 - dot
            own, alive = keep[a : a + PRUNED_AT_ONCE], c != NONE
            count = np.zeros(len(c), np.int64)
            for j in range(c.shape[1]):
                hit = alive[:, j] & (count < most)
                own[:, j] = hit
                count += hit
                alive &= ~(hit[:, None] & (alpha * between[:, j] < d))
            missing = np.maximum(most // 2 - count, 0)
            spare = ~own & (c != NONE)
            own |= spare & (np.cumsum(spare, axis=1) <= missing[:, None])
        return keep

    def _add(self, node: np.ndarray, new: np.ndarray, dist: np.ndarray, most: int | None = None) -> None:
        """Adds edges node -> new; nodes that then have over `most` (r) keep so many of the nearest 2 r, pruned."""
        if not len(node):
            return
        r, most = self.config.r, most or self.config.r
        nodes = np.unique(node)
        held = np.arange(r)[None] < self.count[nodes][:, None]
        src = np.concatenate((np.repeat(nodes, held.sum(1)), node))
        dst = np.concatenate((self.near[nodes][held], new))
        d = np.concatenate((self.dist[nodes][held], dist))
        order = np.lexsort((dst, src))
        src, dst, d = src[order], dst[order], d[order]
        fresh = src != dst
        fresh[1:] &= (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
        src, dst, d = src[fresh], dst[fresh], d[fresh]
        order = np.lexsort((dst, d, src))
        src, dst, d = src[order], dst[order], d[order]
        row = np.searchsorted(nodes, src)
        place = np.arange(len(src)) - np.searchsorted(src, nodes)[row]
        keep = place < 2 * r
        src, dst, d, row, place = (x[keep] for x in (src, dst, d, row, place))
        width = int(place.max(initial=0)) + 1
        near, far = np.full((len(nodes), width), NONE, np.int64), np.full((len(nodes), width), np.inf)
        near[row, place], far[row, place] = dst, d
        chosen = near != NONE
        full = np.flatnonzero(chosen.sum(1) > most)
        if len(full):
            chosen[full] = self._pruned(nodes[full], near[full], far[full], most)
        self._set(nodes, near, far, chosen)

    def _set(self, nodes: np.ndarray, near: np.ndarray, dist: np.ndarray, chosen: np.ndarray) -> None:
        """The chosen candidates, in order, become the nodes' edges."""
        row, column = np.nonzero(chosen)
        place = np.cumsum(chosen, axis=1)[row, column] - 1
        self.near[nodes], self.dist[nodes] = NONE, np.inf
        self.near[nodes[row], place], self.dist[nodes[row], place] = near[row, column], dist[row, column]
        self.count[nodes] = chosen.sum(1)

    def _chain(self, first: np.ndarray, kind: np.ndarray) -> None:
        """Hangs rows that repeat a vector on the first of its kind, one behind the other."""
        order = np.lexsort((np.arange(len(kind)), kind))
        follows = np.flatnonzero(kind[order][1:] == kind[order][:-1])
        for at in follows.tolist():
            a, b = int(order[at]), int(order[at + 1])
            d = float(self._between(np.array([a]), np.array([b]))[0])
            self._force(a, b, d)
            if self.config.r > 1:
                self._force(b, int(first[kind[b]]), d)

    def repair(self) -> Graph:
        """Joins nodes that the entry does not reach to a near reachable node: in a free place, or for an edge that no path needs."""
        parent = self.paths()
        while len(self.ids):
            lost = np.flatnonzero(parent == NONE)
            if not len(lost):
                break
            row, inside = int(lost[0]), np.flatnonzero(parent != NONE)
            d = self.measure(self.unit[row], inside)
            for at in np.lexsort((inside, d)).tolist():
                node = int(inside[at])
                c = int(self.count[node])
                spare = [j for j in range(c) if parent[self.near[node, j]] != node]
                if c < self.config.r:
                    self.count[node] = c + 1
                elif spare:
                    c = max(spare, key=lambda j: (self.dist[node, j], j))
                else:
                    continue
                self.near[node, c], self.dist[node, c] = row, d[at]
                parent[row] = node
                self._spread(parent, np.array([row]))
                break
            else:  # one edge a node and all of them needed: the last of the chain has none to spare
                break
        return self

    def paths(self) -> np.ndarray:
        """Each node's predecessor on a shortest path from the entry (the entry's is itself), NONE out of reach."""
        parent = np.full(len(self.ids), NONE, np.int64)
        if len(self.ids):
            parent[self.entry] = self.entry
            self._spread(parent, np.array([self.entry]))
        return parent

    def _spread(self, parent: np.ndarray, front: np.ndarray) -> None:
        """Goes on from the front, breadth first, to nodes that have no predecessor yet."""
        while len(front):
            held = np.arange(self.config.r)[None] < self.count[front][:, None]
            other, source = self.near[front][held], np.repeat(front, held.sum(1))
            fresh = parent[other] == NONE
            found, at = np.unique(other[fresh], return_index=True)
            parent[found] = source[fresh][at]
            front = found

    def reachable(self) -> np.ndarray:
        return self.paths() != NONE

    def faults(self) -> dict[str, int]:
        """Broken invariants: too many edges, edges to oneself, repeated, dangling, nodes out of reach."""
        n = len(self.ids)
        held = np.arange(self.config.r)[None] < self.count[:, None]
        edges = np.where(held, self.near, NONE)
        ordered = np.sort(edges, axis=1)
        repeated = ((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] != NONE)).sum()
        dangling = (held & ((edges < 0) | (edges >= n))).sum()
        return {"over_degree": int((self.count > self.config.r).sum()), "self_edges": int((edges == np.arange(n)[:, None]).sum()), "repeated_edges": int(repeated), "dangling_edges": int(dangling), "unreachable": int((~self.reachable()).sum())}
