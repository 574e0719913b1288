"""Hierarchical density stops of one user in NumPy: a tree of clusters over falling scales, cut by stability or at a scale."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np

from .kernels import distances, neighbours


def base_cdf(scale: float) -> float:
    """1 - 1 / scale; 1 at infinity, 0 at and below 0."""
    if np.isinf(scale):
        return 1.0
    return 0.0 if scale <= 0 else 1 - 1 / scale


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[b] = a
        return a != b


def core_distances(weights: list[np.ndarray], min_pts: int) -> np.ndarray:
    return np.array([np.partition(w, min_pts - 1)[min_pts - 1] if len(w) >= min_pts else np.inf for w in weights])


class Tree:
    """Clusters by number; 0 is the root. For each: parent, scale of birth, cores at birth; for each core the scale at which it leaves."""

    def __init__(self, t, p, geographic, time_thresh, min_pts, min_cluster_size, dur_min, dist_thresh):
        self.t, self.dur, self.size = t, dur_min * 60, min_cluster_size
        n = len(t)
        near = neighbours(t, p, geographic, dist_thresh, time_thresh)
        weights = [distances(p[x], p[i], geographic) if len(x) else np.empty(0) for i, x in enumerate(near)]
        self.core = core_distances(weights, min_pts)
        self.quarter = [dict(zip(x.tolist(), (np.round(w * 4) / 4).tolist(), strict=True)) for x, w in zip(near, weights, strict=True)]
        edges = sorted((max(self.core[i], self.core[j], w), i, j) for i in range(n) for j, w in self.quarter[i].items() if i < j and np.isfinite(max(self.core[i], self.core[j])))
        union, self.edges = _Union(n), []
        for w, i, j in edges:
            if union.join(i, j):
                self.edges.append((w, i, j))
        self.parent: dict[int, int] = {0: -1}
        self.birth: dict[int, float] = {0: np.inf}
        self.cores: dict[int, set[int]] = {}
        self.leaves: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self._grow(n)

    def borders(self, cores: set[int], scale: float) -> dict[int, int]:
        """Pings that are no core of the cluster, attached to the nearer of the two cores beside them in time, within the scale."""
        order = np.array(sorted(cores))
        out: dict[int, int] = {}
        if not len(order):
            return out
        times = self.t[order]
        for i in sorted({j for c in cores for j in self.quarter[c]} - cores):
            if self.core[i] <= scale:
                continue
            k = int(np.searchsorted(times, self.t[i]))
            sides = [int(order[q]) for q in (k - 1, k) if 0 <= q < len(order) and int(order[q]) in self.quarter[i] and self.quarter[i][int(order[q])] <= scale]
            if sides:
                out[i] = min(sides, key=lambda c: (self.quarter[i][c], c))
        return out

    def _lasting(self, cores: set[int], scale: float) -> bool:
        rows = [*cores, *self.borders(cores, scale)]
        times = self.t[rows]
        return len(cores) >= self.size and times.max() - times.min() >= self.dur

    @staticmethod
    def _parts(nodes: set[int], links: list[tuple[int, int]]) -> list[set[int]]:
        number = {x: k for k, x in enumerate(sorted(nodes))}
        union = _Union(len(number))
        for i, j in links:
            union.join(number[i], number[j])
        out = defaultdict(set)
        for x, k in number.items():
            out[union.find(k)].add(x)
        return [out[k] for k in sorted(out, key=lambda k: min(out[k]))]

    def _new(self, parent: int, cores: set[int], scale: float) -> int:
        c = len(self.parent)
        self.parent[c], self.birth[c], self.cores[c] = parent, scale, set(cores)
        return c

    def _grow(self, n: int) -> None:
        nodes = {i for i in range(n) if np.isfinite(self.core[i])}
        self.cores[0] = set(nodes)
        live: dict[int, tuple[set[int], list]] = {}
        parts = self._parts(nodes, [(i, j) for _, i, j in self.edges]) if nodes else []
        kept = [x for x in parts if self._lasting(x, np.inf)]
        for x in parts:
            if x not in kept:
                self.leaves[0] += [(i, np.inf) for i in x]
        own = lambda x: [e for e in self.edges if e[1] in x]
        if len(kept) == 1:
            live[0] = (set(kept[0]), own(kept[0]))
        else:
            for x in kept:
                live[self._new(0, x, np.inf)] = (set(x), own(x))
                self.leaves[0] += [(i, np.inf) for i in x]
        scales = sorted({w for w, *_ in self.edges} | {float(self.core[i]) for i in nodes}, reverse=True)
        for scale in scales:
            for c in sorted(live):
                members, links = live[c]
                stay = [e for e in links if e[0] < scale]
                left = {i for i in members if self.core[i] < scale or any(i in e[1:] for e in stay)} if any(self.core[i] >= scale for i in members) else members
                if len(stay) == len(links) and len(left) == len(members):
                    continue
                parts = self._parts(left, [(i, j) for _, i, j in stay]) if left else []
                kept = [x for x in parts if self._lasting(x, scale)]
                gone = members - set().union(*kept) if kept else members
                self.leaves[c] += [(i, scale) for i in gone]
                del live[c]
                inner = lambda x: [e for e in stay if e[1] in x]  # noqa: B023, E731
                if len(kept) == 1:
                    live[c] = (set(kept[0]), inner(kept[0]))
                elif len(kept) > 1:
                    for x in kept:
                        live[self._new(c, x, scale)] = (set(x), inner(x))
                        self.leaves[c] += [(i, scale) for i in x]
        for c, (members, _) in live.items():
            self.leaves[c] += [(i, 0.0) for i in members]

    def stability(self, cdf: Callable[[float], float] = base_cdf) -> dict[int, float]:
        return {c: sum(cdf(self.birth[c]) - cdf(s) for _, s in self.leaves[c]) for c in self.parent}

    def most_stable(self, cdf: Callable[[float], float] = base_cdf) -> list[int]:
        """From the leaves up, a parent at least as stable as its chosen descendants takes their place; the root never."""
        value = self.stability(cdf)
        children = defaultdict(list)
        for c, q in self.parent.items():
            if q >= 0:
                children[q].append(c)
        chosen: dict[int, list[int]] = {}
        for c in sorted(self.parent, reverse=True):
            below = [x for k in children[c] for x in chosen[k]]
            total = sum(value[x] for x in below)
            chosen[c] = [c] if not below or value[c] >= total else below
            value[c] = max(value[c], total) if below else value[c]
        return chosen[0]

    def at_scale(self, epsilon: float) -> list[int]:
        """The clusters that are there at the largest scale of at most epsilon."""
        last = {c: min((s for _, s in self.leaves[c]), default=0.0) for c in self.parent}
        return [c for c in self.parent if self.birth[c] > epsilon >= last[c]]


def st_hdbscan(t, p, geographic, time_thresh, min_pts=2, min_cluster_size=1, dur_min=5.0, delta_roam=None, dist_thresh=None, cdf: Callable[[float], float] = base_cdf):
    """Labels (numbers of the tree's clusters) and core labels."""
    n = len(t)
    labels, cores = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return labels, cores
    tree = Tree(t, p, geographic, time_thresh, min_pts, min_cluster_size, dur_min, dist_thresh)
    if not tree.cores[0]:
        return labels, cores
    chosen = tree.at_scale(delta_roam) if delta_roam is not None else tree.most_stable()
    for c in sorted(chosen, key=lambda c: (tree.birth[c], c)):
        own = [i for i in sorted(tree.cores[c]) if labels[i] < 0]
        if not tree._lasting(set(own), tree.birth[c]) if own else True:
            continue
        labels[own] = cores[own] = c
        for i in tree.borders(set(own), tree.birth[c]):
            if labels[i] < 0:
                labels[i] = c
    return labels, cores
