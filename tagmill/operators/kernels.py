"""Numpy kernels for components and groups that have no closed relational form."""

from __future__ import annotations

import heapq
import math
from itertools import product

import numpy as np


#: Products of a sparse multiplication that are held at once.
PRODUCTS = 1 << 21


class Columns:
    """A sparse matrix by columns: rows and values of each, in order of rows."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int):
        order = np.lexsort((row, col))
        row, col, value = row[order], col[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (col[1:] != col[:-1])))) if len(row) else np.zeros(0, np.int64)
        self.row, self.col, self.n = row[first], col[first], n
        self.value = np.add.reduceat(value, first) if len(first) else value
        self.start = np.searchsorted(self.col, np.arange(n + 1))

    def times(self, other: "Columns") -> "Columns":
        """The product, by bounded groups of columns of ``other``."""
        width = np.diff(self.start)[other.row]  # entry (i, j) of other brings column i
        upto = np.concatenate(([0], np.cumsum(width)))
        parts, a = [], 0
        while a < other.n:
            b = max(a + 1, int(np.searchsorted(upto[other.start], upto[other.start[a]] + PRODUCTS, "right")) - 1)
            own = slice(other.start[a], other.start[b])
            w = width[own]
            at = np.repeat(self.start[other.row[own]] - (np.cumsum(w) - w), w) + np.arange(w.sum())
            part = Columns(self.row[at], np.repeat(other.col[own], w), self.value[at] * np.repeat(other.value[own], w), self.n)
            parts.append((part.row, part.col, part.value))
            a = b
        return Columns(*(np.concatenate(x) for x in zip(*parts, strict=True)), self.n)

    def scaled(self) -> "Columns":
        """Columns that sum to one."""
        self.value = self.value / np.bincount(self.col, self.value, self.n)[self.col]
        return self


def markov_clusters(n: int, src: np.ndarray, dst: np.ndarray, inflation: float = 1.6, expansion: int = 2, iterations: int = 100, prune: float = 1e-3) -> list[list[int]]:
    """Markov clustering of a graph of ``n`` nodes: expansion and inflation of the column-stochastic walk until it stands still.

    Columns are sparse: values below ``prune`` go (a column's largest stays), so a column
    has at most 1 / prune entries and memory grows with the nodes, not with their square.
    """
    loop = np.arange(n)
    pairs = np.unique(np.stack([np.concatenate([src, dst, loop]), np.concatenate([dst, src, loop])]).astype(np.int64), axis=1)
    m = Columns(pairs[0], pairs[1], np.ones(pairs.shape[1]), n).scaled()
    for _ in range(iterations):
        last = m
        for _ in range(expansion - 1):
            m = m.times(last)
        m.value = m.value**inflation
        m.scaled()
        order = np.lexsort((m.row, -m.value, m.col))  # the first of a column is its largest, the smallest row of equals
        top = order[np.searchsorted(m.col[order], loop)]
        keep = m.value >= prune
        keep[top] = True
        m = Columns(m.row[keep], m.col[keep], m.value[keep], n).scaled()
        if len(m.row) == len(last.row) and np.array_equal(m.row, last.row) and np.array_equal(m.col, last.col) and np.allclose(m.value, last.value):
            break
    attractors = np.unique(m.row[m.row == m.col])
    own = np.flatnonzero(np.isin(m.row, attractors))
    by_row = own[np.lexsort((m.col[own], m.row[own]))]
    cut = np.flatnonzero(np.concatenate(([True], np.diff(m.row[by_row]) != 0, [True])))
    clusters = {tuple(m.col[by_row[a:b]].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)}
    return [list(c) for c in sorted(clusters)]


def merge_representatives(reps: list[int], link) -> tuple[list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Groups of representatives under pairwise ``link``; approved and disapproved pairs."""
    root = {r: r for r in reps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    yes, no = [], []
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            if link(a, b):
                yes.append((a, b))
                root[max(find(a), find(b))] = min(find(a), find(b))
            else:
                no.append((a, b))
    groups: dict[int, list[int]] = {}
    for r in reps:
        groups.setdefault(find(r), []).append(r)
    return sorted(groups.values()), yes, no


def one_hot(umis: list[str]) -> np.ndarray:
    table = {"A": 0, "C": 1, "T": 3}
    out = np.zeros((len(umis), 4 * max(map(len, umis), default=0)))
    for i, u in enumerate(umis):
        for j, c in enumerate(u):
            out[i, 4 * j + table.get(c, 2)] = 1.0
    return out


def _square_distances(x: np.ndarray) -> np.ndarray:
    n = (x * x).sum(axis=1)
    return np.maximum(n[:, None] + n[None] - 2 * x @ x.T, 0.0)


def dbscan(x: np.ndarray, eps: float = 1.5, min_samples: int = 1) -> np.ndarray:
    """Labels of density clusters, -1 for noise, numbered by first point."""
    near = _square_distances(x) <= eps * eps + 1e-9
    core = near.sum(axis=1) >= min_samples
    labels, at = np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], stack = at, [i]
        while stack:
            p = stack.pop()
            if core[p]:
                for q in np.flatnonzero(near[p] & (labels < 0)):
                    labels[q] = at
                    stack.append(q)
        at += 1
    return labels


def birch(x: np.ndarray, threshold: float = 1.8, branching: int = 50) -> np.ndarray:
    """Labels of the leaf subclusters of a clustering-feature tree (no global step)."""

    class Feature:
        def __init__(self, n, s, ss, child=None):
            self.n, self.s, self.ss, self.child = n, s, ss, child

        def centre(self):
            return self.s / self.n

        def joined(self, o):
            return Feature(self.n + o.n, self.s + o.s, self.ss + o.ss, self.child)

        def radius(self):
            return math.sqrt(max(self.ss / self.n - float(self.centre() @ self.centre()), 0.0))

    def closest(node, f):
        return min(range(len(node)), key=lambda i: float(((node[i].centre() - f.centre()) ** 2).sum()))

    def split(node):
        centres = np.array([f.centre() for f in node])
        d = _square_distances(centres)
        a, b = np.unravel_index(d.argmax(), d.shape)
        left = d[a] < d[b]
        left[a] = True
        parts = [f for f, k in zip(node, left, strict=True) if k], [f for f, k in zip(node, left, strict=True) if not k]
        return [Feature(sum(f.n for f in p), sum(f.s for f in p), sum(f.ss for f in p), p) for p in parts]

    def insert(node, f):
        """Insert into the node; two features if it had to split."""
        if not node:
            node.append(f)
            return None
        i = closest(node, f)
        if node[i].child is not None:
            halves = insert(node[i].child, f)
            if halves is None:
                node[i] = node[i].joined(f)
                return None
            node[i : i + 1] = halves
        else:
            both = node[i].joined(f)
            if both.radius() <= threshold:
                node[i] = both
                return None
            node.append(f)
        return split(node) if len(node) > branching else None

    root: list[Feature] = []
    for row in x:
        halves = insert(root, Feature(1, row.copy(), float(row @ row)))
        if halves:
            root = halves
    leaves, stack = [], list(root)[::-1]
    while stack:
        f = stack.pop()
        if f.child is None:
            leaves.append(f.centre())
        else:
            stack.extend(f.child[::-1])
    if not leaves:
        return np.zeros(0, int)
    centres = np.array(leaves)
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def affinity_propagation(x: np.ndarray, preference: float | None = None, damping: float = 0.5, iterations: int = 200, patience: int = 15) -> np.ndarray:
    """Labels by message passing on negative squared distances; ties broken by a fixed tiny noise.

    Damping, update order, stopping rule and noise are those of the widely used library
    routine, as labels have to equal its.
    """
    n = len(x)
    s = -_square_distances(x)
    if n == 1:
        return np.zeros(1, int)
    off = s[~np.eye(n, dtype=bool)]
    if preference is None:
        preference = float(np.median(s))
    if np.ptp(off) == 0:
        return np.zeros(n, int) if preference < off[0] else np.arange(n)
    s[np.diag_indices(n)] = preference
    s = s + np.random.default_rng(0).standard_normal((n, n)) * (np.finfo(float).eps * np.abs(s) + np.finfo(float).tiny * 100)
    a, r = np.zeros((n, n)), np.zeros((n, n))
    history = []
    for _ in range(iterations):
        t = a + s
        best = t.argmax(axis=1)
        first = t[np.arange(n), best]
        t[np.arange(n), best] = -np.inf
        new = s - first[:, None]
        new[np.arange(n), best] = s[np.arange(n), best] - t.max(axis=1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[np.diag_indices(n)] = r.diagonal()
        new = p.sum(axis=0)[None] - p
        own = new.diagonal().copy()
        new = np.minimum(new, 0)
        new[np.diag_indices(n)] = own
        a = damping * a + (1 - damping) * new
        history.append(tuple(np.flatnonzero(a.diagonal() + r.diagonal() > 0)))
        if len(history) > patience and len(set(history[-patience:])) == 1 and history[-1]:
            break
    centres = np.array(history[-1], int)
    if not len(centres):
        return np.full(n, -1)
    label = s[:, centres].argmax(axis=1)
    label[centres] = np.arange(len(centres))
    for k in range(len(centres)):  # the best member of each cluster leads it
        own = np.flatnonzero(label == k)
        centres[k] = own[s[np.ix_(own, own)].sum(axis=0).argmax()]
    label = s[:, centres].argmax(axis=1)
    label[centres] = np.arange(len(centres))
    _, label = np.unique(centres[label], return_inverse=True)
    return label


def hdbscan(x: np.ndarray, min_samples: int = 3, min_cluster: int = 5) -> np.ndarray:
    """Labels of the most stable clusters of the mutual-reachability hierarchy, -1 for noise."""
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    d = np.sqrt(_square_distances(x))
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, best, via = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    inside[0] = True
    for _ in range(n - 1):
        closer = ~inside & (reach[at] < best)
        best[closer], via[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], via[at], at))
        inside[at] = True
    # single linkage: node ids n.. for merges
    root, members, children, height = list(range(2 * n - 1)), {i: [i] for i in range(n)}, {}, {}
    top = dict(enumerate(range(n)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (w, a, b) in enumerate(sorted(edges)):
        a, b, new = find(a), find(b), n + k
        children[new], height[new] = (a, b), w
        members[new] = members[a] + members[b]
        root[a] = root[b] = new
    level = lambda w: 1 / w if w > 0 else 1e12
    stability, parent_of, kids, start = {}, {}, {}, {}
    stack = [(2 * n - 2, 2 * n - 2, 0.0)]
    stability[2 * n - 2], kids[2 * n - 2], start[2 * n - 2] = 0.0, [], 0.0
    while stack:
        node, name, _ = stack.pop()
        if node < n:
            continue
        lam = level(height[node])
        large = [c for c in children[node] if len(members[c]) >= min_cluster]
        if len(large) == 2:
            stability[name] += len(members[node]) * (lam - start[name])
            for c in large:
                stability[c], kids[c], start[c], parent_of[c] = 0.0, [], lam, name
                kids[name].append(c)
                stack.append((c, c, lam))
        else:
            lost = sum(len(members[c]) for c in children[node] if len(members[c]) < min_cluster)
            stability[name] += lost * (lam - start[name])
            stack += [(c, name, lam) for c in large]
    chosen: dict[int, bool] = {}
    total = dict(stability)
    for name in sorted(stability):
        below = sum(total[c] for c in kids[name])
        chosen[name] = name != 2 * n - 2 and total[name] >= below
        if not chosen[name] and kids[name]:
            total[name] = below
    labels, at, stack = np.full(n, -1), 0, [2 * n - 2]
    while stack:
        name = stack.pop(0)
        if chosen[name]:
            labels[members[name]] = at
            at += 1
        else:
            stack += kids[name]
    return labels


def monomers(umi: str, k: int = 3, mode: str = "vote") -> list[str]:
    """Monomers of a multimer from voted (or all) bases of each block."""
    choices = []
    for i in range(0, len(umi) - k + 1, k):
        block = umi[i : i + k]
        own = list(dict.fromkeys(block))
        if mode == "vote":
            most = max(block.count(c) for c in own)
            own = [c for c in own if block.count(c) == most]
        choices.append(own)
    return sorted({"".join(p) for p in product(*choices)})


def set_cover(multimers: list[str], k: int = 3, mode: str = "vote") -> list[list[str]]:
    """Clusters of multimers: greedily the monomer that covers most (over one) uncovered ones; the rest alone.

    Of equals the first by name. How many a monomer still covers is counted down; a heap
    entry that is out of date goes back with its present number, so nothing is rebuilt.
    """
    of = {m: sorted(set(monomers(m, k, mode))) for m in dict.fromkeys(multimers)}
    covers: dict[str, list[str]] = {}
    for m, names in of.items():
        for mono in names:
            covers.setdefault(mono, []).append(m)
    size = {mono: len(c) for mono, c in covers.items()}
    heap = [(-n, mono) for mono, n in size.items()]
    heapq.heapify(heap)
    left, out = set(of), []
    while heap:
        n, best = heapq.heappop(heap)
        if size[best] < -n:
            heapq.heappush(heap, (-size[best], best))
            continue
        if -n < 2:
            break
        taken = sorted(m for m in covers[best] if m in left)
        out.append(taken)
        left.difference_update(taken)
        for m in taken:
            for mono in of[m]:
                size[mono] -= 1
    return out + [[m] for m in sorted(left)]


def redistribute(rows: list[dict[str, float]], cycles: int = 100, tolerance: float = 1e-5) -> dict[str, float]:
    """Expectation maximisation: weights of features from rows of ambiguous features with counts.

    ``rows`` maps features to the row's count on each; returns expected counts.
    """
    names = sorted({f for r in rows for f in r})
    if not names:
        return {}
    m = np.array([[float(f in r) for f in names] for r in rows])
    count = np.array([max(r.values()) for r in rows])
    w = np.full(len(names), 1 / len(names))
    last = -np.inf
    for _ in range(cycles):
        p = m * w
        total = p.sum(axis=1, keepdims=True)
        loglik = float((count * np.log(total[:, 0])).sum())
        p = p / total * count[:, None]
        w = p.sum(axis=0) / count.sum()
        if abs(loglik - last) < tolerance:
            break
        last = loglik
    return dict(zip(names, (w * count.sum()).tolist(), strict=True))


def merge_bayes(umis: list[str], counts: np.ndarray, quality: np.ndarray, edges: list[tuple[int, int]], posterior, threshold: float = 0.9, rounds: int = 100, others: float = 0) -> list[int]:
    """Merge base into target where the posterior reaches a threshold that grows with the group's live barcodes.

    Each round directs the pairs of live barcodes anew, from the rarer to the more frequent
    (ties: lower quality, then name, is the base), and merges those at the bar by target
    count descending, ratio, quality and names. ``others`` counts the group's barcodes elsewhere.
    """
    count, quality = np.array(counts, float), np.asarray(quality, float)
    rep, live = list(range(len(umis))), set(range(len(umis)))
    pairs = sorted(((u, v) if umis[u] < umis[v] else (v, u) for u, v in edges), key=lambda e: (umis[e[0]], umis[e[1]]))
    for _ in range(rounds):
        pairs = [(u, v) for u, v in pairs if u in live and v in live]
        if not pairs:
            break
        u, v = np.array(pairs).T
        first = (count[u] < count[v]) | (count[u] == count[v]) & (quality[u] <= quality[v])
        base, target = np.where(first, u, v), np.where(first, v, u)
        ratio = count[base] / np.maximum(count[target], 1)
        bar = min(threshold + 0.05 * math.log1p(len(live) + others), 0.99)
        chosen = np.flatnonzero(posterior(quality[base], ratio, count[base]) >= bar)
        chosen = chosen[np.lexsort((quality[base][chosen], ratio[chosen], -count[target][chosen]))]
        if not len(chosen):
            break
        for b, t in zip(base[chosen].tolist(), target[chosen].tolist(), strict=True):
            if b in live and t in live:
                count[t] += count[b]
                rep[b] = t
                live.remove(b)
    for i in range(len(rep)):
        while rep[i] != rep[rep[i]]:
            rep[i] = rep[rep[i]]
    return rep


def merge_classic(nodes: list[tuple[str, int]], edges: list[tuple[int, int]], multiplier: float = 1.0) -> list[int]:
    """One pass over pairs: the rarer is merged into the other if its count is at most ``multiplier`` times as large."""
    count, rep, alive = [c for _, c in nodes], list(range(len(nodes))), [True] * len(nodes)
    for u, v in edges:
        if not (alive[u] and alive[v]):
            continue
        u, v = (u, v) if count[u] <= multiplier * count[v] else (v, u)
        rep[u], alive[u] = v, False
        count[v] += count[u]
    for i in range(len(rep)):
        while rep[i] != rep[rep[i]]:
            rep[i] = rep[rep[i]]
    return rep


def parent_paths(count: dict[int, int], features: dict[int, set[str]], arcs: list[tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """Molecules of a component of equivalence classes: (parent, members) with the fewest paths.

    Every class without an arc into it starts a path that takes the unclaimed classes it
    reaches and shares a feature with; the order of parents is by how many classes they
    reach, then count, then index.
    """
    out: dict[int, list[int]] = {}
    for u, v in arcs:
        out.setdefault(u, []).append(v)
    targets = {v for _, v in arcs}

    def reach(u):
        seen, stack = {u}, [u]
        while stack:
            for v in out.get(stack.pop(), ()):
                if v not in seen and features[v] & features[u]:
                    seen.add(v)
                    stack.append(v)
        return seen

    left, paths = set(count), []
    order = sorted(count, key=lambda u: (u in targets, -len(reach(u)), -count[u], u))
    for u in order:
        if u in left:
            own = reach(u) & left
            paths.append((u, sorted(own)))
            left -= own
    return paths
