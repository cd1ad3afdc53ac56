"""Hierarchical clustering of the points of one cell, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from simplicia.functions.distances import DEFAULT, Distance, distance_matrix
from simplicia.functions.scale import Selector

#: What clusters the points of a cell: (rows, distance, method) to a dendrogram; :func:`cluster` unless another is given.
Provider = Callable[[np.ndarray, Distance, str], "Dendrogram"]
#: Points in a block of a spanning tree.
BLOCK = 2000
#: Clusters whose distances make one matrix; of more, rows are taken from the points as they are needed.
MATRIX = 4000
#: Numbers in the rows that are taken at once, and in the rows of large clusters that are kept.
ROWS, KEPT = 1 << 19, 1 << 23
#: Neighbours that a cluster keeps.
NEAR = 8
_FAR = np.finfo(float).max  # for a distance that isn't a number or has no end
METHODS = ("single", "complete", "upgma", "wpgma", "upgmc", "wpgmc", "ward")
_SQUARED, _HALVES = ("ward", "upgmc", "wpgmc"), ("wpgma", "wpgmc")


@dataclass(frozen=True)
class Dendrogram:
    """``n`` points; row k of ``merges`` joins two nodes (points first, then earlier merges) at ``heights[k]``."""

    n: int
    merges: np.ndarray
    heights: np.ndarray
    diameter: float

    def all_heights(self, with_diameter: bool = True) -> np.ndarray:
        return np.append(self.heights, self.diameter) if with_diameter and self.n > 1 else self.heights

    def labels(self, cutoff: float) -> np.ndarray:
        """Clusters, numbered by their first point, after all merges strictly below ``cutoff``; one cluster if heights fall or all are below."""
        if self.n < 2 or self.heights.max() < cutoff or (np.diff(self.heights) < 0).any():
            return np.zeros(self.n, dtype=int)
        parent = np.arange(2 * self.n - 1)
        for k in np.flatnonzero(self.heights < cutoff):
            parent[self.merges[k]] = self.n + k
        for k in range(len(parent) - 1, -1, -1):
            parent[k] = parent[parent[k]]
        _, first, inverse = np.unique(parent[: self.n], return_index=True, return_inverse=True)
        return np.argsort(np.argsort(first))[inverse]


def cluster(x: np.ndarray, distance: Distance = DEFAULT, method: str = "single") -> Dendrogram:
    """Dendrogram of the rows of ``x``. Single linkage takes a minimum spanning tree; one feature needs only sorting."""
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown linkage {method!r}; one of {', '.join(METHODS)}")
    x = np.asarray(x, float)
    n = len(x)
    if n < 2:
        return Dendrogram(n, np.zeros((0, 2), int), np.zeros(0), 0.0)
    if method == "single":
        if x.shape[1] == 1 and distance.name in ("manhattan", "euclidean", "chebyshev"):
            order = np.argsort(x[:, 0], kind="stable")
            edges = np.stack([order[:-1], order[1:]], axis=1)
            weights = np.diff(x[order, 0])
            diameter = float(x[order[-1], 0] - x[order[0], 0])
        else:
            edges, weights, diameter = _spanning_tree(x, distance)
        return _from_tree(n, edges, weights, diameter)
    return _lance_williams(distance_matrix(x, distance), method) if n <= MATRIX else _from_points(x, distance, method)


def _spanning_tree(x: np.ndarray, distance: Distance):
    """Edges, weights and diameter of a minimum spanning tree, by blocks.

    An edge of the whole's tree is in the tree of every part that holds it, so trees between all pairs of blocks hold it;
    their edges are merged as they gather. Memory: two blocks' distances and a few edges a point."""
    n, fast = len(x), distance.name == "euclidean"
    if fast:  # squares from inner products find the edges; small ones, edges and the diameter are taken exactly
        near = x - x.mean(0)
        square = (near * near).sum(1)
    exact = lambda i, j: ((x[i] - x[j]) ** 2).sum(1)
    diameter, kept, held = 0.0, [], 0
    for p in range(0, n, BLOCK):
        for q in range(p, n, BLOCK):
            if fast:
                both = square[p : p + BLOCK, None] + square[None, q : q + BLOCK]
                d = both - 2 * (near[p : p + BLOCK] @ near[q : q + BLOCK].T)
                for r, row in enumerate(d <= 1e-6 * both):
                    if row.any():
                        c = np.flatnonzero(row)
                        d[r, c] = exact(np.full(len(c), p + r), q + c)
                r, c = np.unravel_index(d.argmax(), d.shape)
                diameter = max(diameter, float(exact([p + r], [q + c])[0]))
            else:
                d = distance.block(x[p : p + BLOCK], x[q : q + BLOCK])
                if p == q:
                    np.fill_diagonal(d, 0)
                diameter = float(np.max(d, where=d < np.inf, initial=diameter))
                d[~(d < np.inf)] = _FAR
            i, j, w = _tree_of_block(d, p == q)
            i, j = i + p, j + q
            kept.append((i, j, exact(i, j) if fast else w))
            held += len(i)
            if held > 20 * n + 8 * BLOCK:
                kept = [_forest(n, kept)]
                held = len(kept[0][2])
    i, j, w = _forest(n, kept)
    edges = np.stack([i, j], axis=1)
    return (edges, np.sqrt(w), diameter**0.5) if fast else (edges, np.where(w < _FAR, w, np.inf), diameter)


def _tree_of_block(d: np.ndarray, same: bool):
    """Rows, columns and weights of a minimum spanning tree (Prim's) of a matrix's points or, unless it is of the ``same``
    points both ways, of its rows and columns with no edge among either."""
    a, c = d.shape
    n, t = (a, d) if same else (a + c, np.ascontiguousarray(d.T))
    best, bound, source = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, np.int64)
    ends, order = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = 0
    for k in range(n):
        order[k], ends[k] = at, source[at]
        best[at], bound[at] = np.inf, -np.inf  # it is in the tree
        if same:
            row, first = d[at], 0
        elif at < a:
            row, first = d[at], a
        else:
            row, first = t[at - a], 0
        near = np.flatnonzero(row < bound[first : first + len(row)])
        own = row[near]
        near += first
        best[near] = bound[near] = own
        source[near] = at
        at = int(best.argmin())
    i, j = np.minimum(order[1:], ends[1:]), np.maximum(order[1:], ends[1:])
    if not same:
        j -= a
    return i, j, d[i, j]


def _forest(n: int, parts: list):
    """The edges of a minimum spanning tree among those of ``parts``, lightest first (Kruskal's)."""
    i, j, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(w, kind="stable")
    root, keep = list(range(n)), []
    for e, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a != b:
            root[b] = a
            keep.append(e)
            if len(keep) == n - 1:
                break
    return i[keep], j[keep], w[keep]


def _from_tree(n: int, edges: np.ndarray, weights: np.ndarray, diameter: float) -> Dendrogram:
    order = np.argsort(weights, kind="stable")
    root, node = list(range(n)), list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    merges = np.zeros((n - 1, 2), int)
    for k, e in enumerate(order):
        a, b = find(int(edges[e, 0])), find(int(edges[e, 1]))
        merges[k] = sorted((node[a], node[b]))
        root[b] = a
        node[a] = n + k
    return Dendrogram(n, merges, weights[order], diameter)


def _lance_williams(d: np.ndarray, method: str) -> Dendrogram:
    """The dendrogram of a matrix of distances. ``d`` is overwritten: memory is one matrix."""
    n = len(d)
    diameter = float(d.max())
    if method in _SQUARED:
        d *= d
    merges, heights = np.zeros((n - 1, 2), int), np.zeros(n - 1)
    _merge_all(d, method, np.ones(n), np.arange(n), merges, heights)
    return Dendrogram(n, merges, heights, diameter)


def _merge_all(d: np.ndarray, method: str, size: np.ndarray, node: np.ndarray, merges: np.ndarray, heights: np.ndarray) -> None:
    """Merges the nearest two, of equals the first by row and column, into the last rows of ``merges`` and ``heights``.

    ``d`` (squares, for methods of squares) is overwritten. Every row keeps its nearest column, so a merge costs a few rows
    and not the whole matrix."""
    n, total = len(d), len(merges) + 1
    squared = method in _SQUARED
    np.fill_diagonal(d, np.inf)
    live = np.ones(n, bool)
    # each row's least distance and its first column; where ``stale``, only a bound below it, until the row comes first
    nearest = d.argmin(1)
    least = d[np.arange(n), nearest]
    stale = np.zeros(n, bool)
    for k in range(total - n, total - 1):
        i = int(least.argmin())
        while stale[i]:
            nearest[i] = d[i].argmin()
            least[i], stale[i] = d[i, nearest[i]], False
            i = int(least.argmin())
        j = int(nearest[i])
        if least[i] == np.inf:  # so are all
            i, j = np.flatnonzero(live)[:2].tolist()
        i, j = min(i, j), max(i, j)
        h, a, b = d[i, j], size[i], size[j]
        merges[k], heights[k] = sorted((node[i], node[j])), np.sqrt(max(h, 0)) if squared else h
        x, y = d[i].copy(), d[j].copy()
        if method == "complete":
            new = np.maximum(x, y)
        elif method == "upgma":
            new = (a * x + b * y) / (a + b)
        elif method == "wpgma":
            new = (x + y) / 2
        elif method == "upgmc":
            new = (a * x + b * y) / (a + b) - a * b * h / (a + b) ** 2
        elif method == "wpgmc":
            new = (x + y) / 2 - h / 4
        else:
            new = ((a + size) * x + (b + size) * y - size * h) / (a + b + size)
        live[j] = False
        new[~live] = np.inf
        new[i] = np.inf
        d[i, :], d[:, i] = new, new
        d[j, :] = d[:, j] = np.inf
        lost = (nearest == i) | (nearest == j)
        stale |= lost
        closer = (new < least) | ((new == least) & ~stale & (i < nearest))
        least[closer], nearest[closer], stale[closer] = new[closer], i, False
        nearest[i] = new.argmin()
        least[i], stale[i] = new[nearest[i]], False
        least[j], stale[j], nearest[j] = np.inf, False, -1
        size[i] += b
        node[i] = total + k


class _Clusters:
    """Clusters of points and, for some of them at a time, their distances to all (squares, for methods of squares).

    A distance is the largest or a weighted mean of those between points; methods of squares subtract the means inside both
    clusters, or have centres if the distance is Euclidean. Memory is linear in the points but for ``ROWS`` and ``KEPT``."""

    def __init__(self, x: np.ndarray, count: np.ndarray, distance: Distance, method: str):
        n = len(x)
        self.distance, self.method, self.diameter = distance, method, 0.0
        self.fast, self.squared = distance.name == "euclidean", method in _SQUARED
        self.central = self.fast and self.squared  # then x holds the centres
        self.x = x - x.mean(0) if self.fast else x
        self.square = (self.x * self.x).sum(1)
        self.size, self.inner = count.astype(float), np.zeros(n)
        self.label, self.weight = np.arange(n), np.ones(n)
        self.kept, self.large = {}, max(2, n * n // KEPT)  # so few clusters are large that their rows fit in KEPT
        self.apart = True  # no two points are merged yet

    def _block(self, rows: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
        """Distances of points to all, or to other points."""
        if self.fast:
            d = _squares(self.x, self.square, rows, columns)
            return d if self.squared else np.sqrt(d, out=d)
        if columns is not None:
            d = self.distance.block(self.x[rows], self.x[columns])
        else:
            d = np.concatenate([self.distance.block(self.x[rows], self.x[q : q + BLOCK]) for q in range(0, len(self.x), BLOCK)], axis=1)
            d[np.arange(len(rows)), rows] = 0
        return d * d if self.squared else d

    def _to_points(self, slots: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
        """The largest or mean distance of each cluster to every point."""
        n = len(self.x)
        out, held, total = np.empty((len(slots), n)), [], 0
        for k, s in enumerate(slots.tolist()):
            if s in self.kept:
                out[k] = self.kept[s]
            else:
                held.append(k)
                total += len(members[k])
            if held and (total * n >= ROWS or k == len(slots) - 1):
                rows = np.concatenate([members[h] for h in held])
                d, at = self._block(rows), 0
                for h in held:
                    own = members[h]
                    part = d[at : at + len(own)]
                    out[h] = part[0] if len(own) == 1 else part.max(0) if self.method == "complete" else self.weight[own] @ part
                    at += len(own)
                held, total = [], 0
        return out

    def rows(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each of the clusters, infinite at itself and at what is merged into others, and its columns' clusters."""
        if self.central:
            out, ids = _squares(self.x, self.square, slots), np.arange(len(self.size))
        else:
            order = np.argsort(self.label, kind="stable")
            label = self.label[order]
            low, high = np.searchsorted(label, slots), np.searchsorted(label, slots, side="right")
            out = self._to_points(slots, [order[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            first = np.flatnonzero(np.diff(label, prepend=-1))
            ids = label[first]
            if len(ids) < len(label):
                out = out[:, order]
                if self.method == "complete":
                    out = np.maximum.reduceat(out, first, axis=1)
                else:
                    out *= self.weight[order]
                    out = np.add.reduceat(out, first, axis=1)
            if self.squared:
                out -= self.inner[slots, None] + self.inner[ids]
                np.maximum(out, 0, out=out)
        if self.apart:
            top = float(out.max())
            self.diameter = max(self.diameter, top**0.5 if self.squared else top)
        if self.method == "ward":
            a, b = self.size[slots, None], self.size[ids]
            out *= 2 * a * b / (a + b)
        out[:, self.size[ids] == 0] = np.inf
        out[np.arange(len(slots)), np.searchsorted(ids, slots)] = np.inf
        return out, ids

    def between(self, i: int, slots: np.ndarray) -> np.ndarray:
        """Distances of one cluster to a few."""
        if self.central:
            out = ((self.x[slots] - self.x[i]) ** 2).sum(1)
        else:
            taken = np.zeros(len(self.size), bool)
            taken[slots] = True
            points = np.flatnonzero(taken[self.label])
            points = points[np.argsort(self.label[points], kind="stable")]
            first = np.flatnonzero(np.diff(self.label[points], prepend=-1))
            if i in self.kept:
                out = self.kept[i][points]
            else:
                own = np.flatnonzero(self.label == i)
                out = self._block(own, points)
                out = out.max(0) if self.method == "complete" else self.weight[own] @ out
            if self.method == "complete":
                out = np.maximum.reduceat(out, first)
            else:
                out = np.add.reduceat(out * self.weight[points], first)
            if self.squared:
                out = np.maximum(out - self.inner[i] - self.inner[slots], 0)
        if self.method == "ward":
            a, b = self.size[i], self.size[slots]
            out *= 2 * a * b / (a + b)
        return out

    def merge(self, i: int, j: int, h: float) -> None:
        """Cluster ``j`` goes into ``i``, from which it is ``h`` apart."""
        a, b = self.size[i], self.size[j]
        p = 0.5 if self.method in _HALVES else a / (a + b)
        if self.central:
            self.x[i] = p * self.x[i] + (1 - p) * self.x[j]
            self.square[i] = self.x[i] @ self.x[i]
        else:
            ours, theirs = np.flatnonzero(self.label == i), np.flatnonzero(self.label == j)
            if len(ours) + len(theirs) >= self.large:
                u, v = self._to_points(np.array([i, j]), [ours, theirs])
                self.kept.pop(j, None)
                self.kept[i] = np.maximum(u, v) if self.method == "complete" else p * u + (1 - p) * v
            self.inner[i] = p * self.inner[i] + (1 - p) * self.inner[j] + p * (1 - p) * (h * (a + b) / (2 * a * b) if self.method == "ward" else h)
            self.weight[ours] *= p
            self.weight[theirs] *= 1 - p
            self.label[theirs] = i
        self.size[i], self.size[j], self.apart = a + b, 0, False

    def compact(self) -> np.ndarray:
        """Drops what is merged into others; returns the clusters that stay."""
        stay = np.flatnonzero(self.size)
        if self.central:
            self.x, self.square = self.x[stay], self.square[stay]
        else:
            place = np.cumsum(self.size > 0) - 1
            self.label, self.kept = place[self.label], {int(place[s]): v for s, v in self.kept.items()}
            self.inner = self.inner[stay]
        self.size = self.size[stay]
        return stay


def _squares(x: np.ndarray, square: np.ndarray, rows: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of some rows of ``x`` to all or others, from inner products; small ones are taken exactly."""
    y, other = (x, square) if columns is None else (x[columns], square[columns])
    d = (-2 * x[rows]) @ y.T
    d += square[rows, None]
    d += other
    small = 1e-6 * (square[rows] + other.max())
    for k in np.flatnonzero(d.min(1) <= small):
        c = np.flatnonzero(d[k] <= small[k])
        d[k, c] = ((x[rows[k]] - y[c]) ** 2).sum(1)
    return d


def _by_neighbours(c: _Clusters, batch: int):
    """Merges the nearest two, of equals any, until ``MATRIX`` clusters are left; for methods whose distances don't fall.

    Yields both clusters, their distance and, if clusters were renumbered, those that stay. Every cluster keeps its ``NEAR``
    nearest and a bound below its distances to the rest. By a merge no distance falls below both that it comes from, so bounds
    hold: only distances to the kept are taken anew, and a whole row when the bound comes first."""
    m = left = len(c.size)
    near, value, bound = np.full((m, NEAR), -1, np.int32), np.full((m, NEAR), np.inf), np.full(m, -np.inf)
    least, stale = bound.copy(), np.ones(m, bool)
    while left > MATRIX:
        i = int(least.argmin())
        if stale[i]:
            slots = np.flatnonzero(stale)
            if len(slots) > batch:
                slots = np.sort(slots[np.argpartition(least[slots], batch)[:batch]])
            (rows, ids), at = c.rows(slots), np.arange(len(slots))
            for t in range(NEAR):
                best = rows.argmin(1)
                value[slots, t] = rows[at, best]
                near[slots, t] = np.where(rows[at, best] < np.inf, ids[best], -1)
                rows[at, best] = np.inf
            bound[slots] = rows.min(1)
            least[slots], stale[slots] = value[slots, 0], False
            continue
        j, h = int(near[i, value[i].argmin()]), float(least[i])
        if not h < np.inf:  # so are all
            i, j = np.flatnonzero(c.size)[:2].tolist()
        i, j = min(i, j), max(i, j)
        c.merge(i, j, h)
        left -= 1
        close = np.union1d(near[i], near[j])
        close = close[(close >= 0) & (close != i) & (close != j)]
        near[i] = near[j] = -1
        hit = np.unique(np.flatnonzero((near == i) | (near == j)) // NEAR)
        slots = np.union1d(close, hit)
        new = c.between(i, slots) if len(slots) else np.zeros(0)
        if len(hit):
            ids, values = near[hit], value[hit]
            met = (ids == i) | (ids == j)
            ids[met], values[met] = -1, np.inf
            at, first = np.arange(len(hit)), met.argmax(1)
            ids[at, first], values[at, first] = i, new[np.searchsorted(slots, hit)]
            near[hit], value[hit] = ids, values
        own = new[np.searchsorted(slots, close)]
        order = np.argsort(own, kind="stable")
        own, close = own[order], close[order]
        bound[i] = min(bound[i], bound[j], *own[NEAR : NEAR + 1].tolist())
        value[i], value[j], bound[j] = np.inf, np.inf, np.inf
        value[i, : len(own)], near[i, : len(own)] = own[:NEAR], close[:NEAR]
        hit = np.append(hit, i)
        least[hit] = value[hit].min(1)
        stale[hit] = ~(least[hit] <= bound[hit])
        least[hit] = np.minimum(least[hit], bound[hit])
        least[j], stale[j] = np.inf, False
        stay = None
        if left < 0.8 * len(least):
            stay, place = c.compact(), np.full(len(least) + 1, -1, np.int32)
            place[stay] = np.arange(len(stay))
            near, value, bound, least, stale = place[near[stay]], value[stay], bound[stay], least[stay], stale[stay]
        yield i, j, h, stay


def _by_rows(c: _Clusters, batch: int):
    """As :func:`_by_neighbours` for upgmc and wpgmc, whose centres may come nearer by a merge: its row is taken at once.

    Every cluster keeps its nearest and a bound below its distances to the rest or, if ``stale``, to all."""
    m = left = len(c.size)
    least, second, nearest, stale = np.full(m, -np.inf), np.full(m, -np.inf), np.full(m, -1), np.ones(m, bool)
    while left > MATRIX:
        i = int(least.argmin())
        if stale[i]:
            slots = np.flatnonzero(stale)
            if len(slots) > batch:
                slots = np.sort(slots[np.argpartition(least[slots], batch)[:batch]])
            (rows, ids), at = c.rows(slots), np.arange(len(slots))
            best = rows.argmin(1)
            nearest[slots], least[slots], stale[slots] = ids[best], rows[at, best], False
            rows[at, best] = np.inf
            second[slots] = rows.min(1)
            continue
        j, h = int(nearest[i]), float(least[i])
        if h == np.inf:  # so are all
            i, j = np.flatnonzero(c.size)[:2].tolist()
        i, j = min(i, j), max(i, j)
        c.merge(i, j, h)
        left -= 1
        live = c.size > 0
        row, ids = c.rows(np.array([i]))
        new = np.full(len(least), np.inf)
        new[ids] = row[0]
        lost = (nearest == i) | (nearest == j) | stale
        closer = (new <= np.where(lost, second, least)) & live
        far, passed, others = lost & ~closer & live, closer & ~lost, ~closer & ~lost
        second[passed] = least[passed]
        np.minimum(second, new, out=second, where=others)
        least[closer], nearest[closer], stale[closer] = new[closer], i, False
        least[far], nearest[far], stale[far] = second[far], -1, True
        nearest[i], stale[i] = new.argmin(), False
        least[i], second[i] = np.partition(new, 1)[:2]
        least[j], second[j], nearest[j], stale[j] = np.inf, np.inf, -1, False
        stay = None
        if left < 0.8 * len(least):
            stay, place = c.compact(), np.full(len(least) + 1, -1)
            place[stay] = np.arange(len(stay))
            least, second, nearest, stale = least[stay], second[stay], place[nearest[stay]], stale[stay]
        yield i, j, h, stay


def _from_points(x: np.ndarray, distance: Distance, method: str) -> Dendrogram:
    """As :func:`_lance_williams`, without a matrix of the points: it comes once no more than ``MATRIX`` clusters are left.

    Copies are merged first."""
    n, k, firsts, count, groups = len(x), 0, [], [], {}
    merges, heights, node = np.zeros((n - 1, 2), int), np.zeros(n - 1), []
    for p, row in enumerate(x + 0.0):
        g = groups.setdefault(row.tobytes(), len(groups))
        if g == len(firsts):
            firsts.append(p)
            node.append(p)
            count.append(1)
        else:
            merges[k], node[g] = sorted((node[g], p)), n + k
            count[g] += 1
            k += 1
    del groups
    node = np.array(node)
    c = _Clusters(x[firsts], np.array(count), distance, method)
    batch = max(1, ROWS // len(firsts))
    falls = method in ("upgmc", "wpgmc")
    for i, j, h, stay in (_by_rows if falls else _by_neighbours)(c, batch):
        merges[k], heights[k] = sorted((node[i], node[j])), h**0.5 if c.squared else h
        node[i], k = n + k, k + 1
        node = node if stay is None else node[stay]
    node = node[c.compact()]
    left = len(node)
    d = np.empty((left, left))
    for p in range(0, left, batch):
        part = c.rows(np.arange(p, min(left, p + batch)))[0][:, p:]
        d[p : p + batch, p:] = part
        d[p:, p : p + batch] = part.T
    c.kept.clear()
    _merge_all(d, method, c.size, node, merges, heights)
    if not falls:  # but for rounding
        np.maximum.accumulate(heights, out=heights)
    return Dendrogram(n, merges, heights, c.diameter)


def local_labels(x: np.ndarray, distance: Distance, method: str, scale: Selector, provider: Provider = cluster) -> np.ndarray:
    """Labels of one cell at the height that ``scale`` selects; all points together if it fails."""
    tree = provider(x, distance, method)
    try:
        return tree.labels(scale(tree.all_heights()))
    except (ValueError, ArithmeticError):
        return np.zeros(tree.n, int)
