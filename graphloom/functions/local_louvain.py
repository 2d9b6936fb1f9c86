"""The level loop on arrays, for graphs small enough for one task.

The same rules as the DataFrame operators in operators.louvain: degree buckets move one after another, all vertices of
a bucket against one snapshot.  Contracted graphs get small quickly; there a task of array operations replaces dozens of jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Upper bounds of the degree buckets (fixed values); the last bucket is open.
BUCKET_TOPS = (4, 8, 16, 32, 84, 319)


def bucket_of(degree: np.ndarray) -> np.ndarray:
    """0 for isolated vertices, which never move; else 1 to 7."""
    return np.where(degree == 0, 0, np.searchsorted(np.array(BUCKET_TOPS), degree, "left") + 1)


class Graph:
    """Arcs sorted by source, with ids 0 to n - 1."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, node_w: np.ndarray | None = None):
        order = np.lexsort((dst, src))
        self.n, self.src, self.dst, self.w = n, src[order], dst[order], w[order]
        self.node_w = np.ones(n, np.int64) if node_w is None else node_w
        self.first = np.searchsorted(self.src, np.arange(n + 1))
        self.degree = np.diff(self.first)
        self.k = np.bincount(self.src, self.w, n) if self.w.dtype.kind == "f" else _int_sums(self.src, self.w, n)
        self.m2 = self.k.sum()
        self.exact = self.w.dtype.kind != "f"

    def quality(self, labels: np.ndarray) -> float:
        if self.m2 == 0:
            return 0.0
        same = labels[self.src] == labels[self.dst]
        inside = self.w[same].sum()
        tot = _sums(labels, self.k, int(labels.max()) + 1 if self.n else 0)
        if self.exact:
            return (int(self.m2) * int(inside) - int((tot.astype(object) ** 2).sum())) / int(self.m2) ** 2
        return float(inside / self.m2 - (tot.astype(float) ** 2).sum() / self.m2**2)


def _int_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n) if values.dtype.kind == "f" else _int_sums(at, values, n)


def _near(g: Graph, labels: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertex, adjacent community, weight between them, loops left out) of the vertices in `who`, in order."""
    count = g.degree[who]
    arc = np.repeat(g.first[who] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    return grouped(g.src[arc], g.dst[arc], g.w[arc], labels)


def grouped(v: np.ndarray, t: np.ndarray, w: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from arcs (v, t, w)."""
    keep = v != t
    v, c, w = v[keep], labels[t[keep]], w[keep]
    if len(v) == 0:
        return v, c, w
    order = np.lexsort((c, v))
    v, c, w = v[order], c[order], w[order]
    begin = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])]))
    e = np.add.reduceat(w, begin)
    return v[begin], c[begin], e


def best_moves(g: Graph, labels: np.ndarray, who: np.ndarray, tot: np.ndarray, size: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vertices that move, their new communities) among `who`, against the given snapshot; only: allowed vertex * n + community."""
    return best_of(*_near(g, labels, who), labels, g.k, g.m2, tot, size, only)


def best_of(v: np.ndarray, c: np.ndarray, e: np.ndarray, labels: np.ndarray, weighted_degree: np.ndarray, m2, tot: np.ndarray, size: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same from all (vertex, adjacent community, weight) of some vertices."""
    if len(v) == 0:
        return v, c
    n, exact = len(weighted_degree), weighted_degree.dtype.kind != "f"
    cur = labels[v]
    own = np.zeros(n, e.dtype)
    mine = c == cur
    own[v[mine]] = e[mine]
    allowed = ~mine & ((c < cur) | (size[c] > 1) | (size[cur] > 1))
    if only is not None:
        allowed &= np.isin(v.astype(np.int64) * n + c, only)
    v, c, e, cur = v[allowed], c[allowed], e[allowed], cur[allowed]
    k = weighted_degree[v]
    if exact and int(m2) * int(m2) > 2**62:
        # beyond 64 bits: Python integers
        gain = int(m2) * (e - own[v]).astype(object) + k.astype(object) * ((tot[cur] - k) - tot[c]).astype(object)
    else:
        gain = m2 * (e - own[v]) + k * ((tot[cur] - k) - tot[c])
        if not exact:
            gain = np.round(gain, 9)
    good = gain > 0
    v, c, gain = v[good], c[good], gain[good]
    # the largest gain, then the lowest community
    order = np.lexsort((c, -gain, v)) if gain.dtype != object else np.array(sorted(range(len(v)), key=lambda i: (v[i], -gain[i], c[i])), int)
    v, c = v[order], c[order]
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    return v[first], c[first]


@dataclass(frozen=True)
class Rule:
    """A criterion of functions.quality by id, with the totals of the prepared graph; the same formulas on arrays."""

    id: int
    m2: float
    n: float
    mx: float
    extra: float
    alpha: float = 0.5
    kappa_min: int = 1

    def score(self, in_w: np.ndarray, tot: np.ndarray, cw: np.ndarray) -> float:
        m2, n, mx, square = self.m2, self.n, self.mx, self.n * self.n * self.mx
        scale = {0: m2, 3: n * mx, 4: n * n, 5: m2, 6: m2, 8: n}.get(self.id, square)
        if scale == 0 or len(cw) == 0:
            return 0.0
        total = {
            0: lambda: (in_w - _over(tot * tot, m2))[tot > 0].sum(),
            1: lambda: (2 * in_w - mx * cw * cw).sum() + square - m2,
            2: lambda: (in_w - self.alpha * mx * cw * cw).sum() + self.alpha * (square - m2),
            3: lambda: (in_w / (2 * cw)).sum(),
            4: lambda: in_w.sum() + self.extra,
            5: lambda: (in_w - 2 * tot * cw / n).sum() + m2 / (n * n) * (cw * cw).sum(),
            6: lambda: in_w.sum() - m2 / (n * n) * (cw * cw).sum(),
            7: lambda: (2 * in_w / cw).sum() - self.extra - len(cw),
            8: lambda: _over(in_w, tot)[tot > 0].sum() - len(cw),
            9: lambda: (2 * in_w - _over(tot * tot, m2) - mx * cw * cw + self._balance(cw * n * mx - tot, n * cw * mx - tot)).sum(),
        }[self.id]()
        return float(total / scale)

    def _balance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rest = self.n * self.n * self.mx - self.m2
        return a * b / rest if rest else np.zeros(len(a))

    def gain(self, dnc, k, s, u, in_w, tot, cw, kappa) -> np.ndarray:
        """Ranking value of a move into a community that the vertex has left."""
        m2, n, mx = self.m2, self.n, self.mx
        return {
            0: lambda: dnc - _over(tot * k, m2),
            1: lambda: 2 * dnc - u * cw * mx,
            2: lambda: dnc - self.alpha * u * cw * mx,
            3: lambda: np.where(cw == 0, (2 * dnc + s) / (2 * u), (in_w + 2 * dnc + s) / (2 * (cw + u)) - _over(in_w, 2 * cw)),
            4: lambda: dnc + 0.0,
            5: lambda: dnc - (tot * u + k * cw) / n + m2 * u * cw / (n * n),
            6: lambda: dnc - m2 * u * cw / (n * n),
            7: lambda: _ratio_gain(dnc, s, in_w, cw, u, 0.5),
            8: lambda: np.where(kappa < self.kappa_min, 0.0, _ratio_gain(dnc, s, in_w, tot, k, 1.0)),
            9: lambda: 2 * dnc - _over(k * tot, m2) - u * cw * mx + self._balance(n * u * mx - k, n * cw * mx - tot),
        }[self.id]()


def _over(a: np.ndarray, b) -> np.ndarray:
    """a / b, 0 where that is undefined."""
    b = np.broadcast_to(np.asarray(b, float), np.shape(a))
    return np.divide(a, b, out=np.zeros(np.shape(a)), where=b != 0)


def _ratio_gain(dnc, s, own, size, after, empty_minus: float) -> np.ndarray:
    start = _over(2 * dnc + s, after) - empty_minus
    return np.where(size == 0, start, _over(own + 2 * dnc + s, size + after) - _over(own, size))


class _Modularity:
    """State of a partition under exact modularity."""

    def __init__(self, g: Graph, labels: np.ndarray):
        self.g, self.top = g, max(g.n, int(labels.max()) + 1 if len(labels) else 0)
        self.update(labels)

    def update(self, labels: np.ndarray) -> None:
        self.labels, self.tot, self.size = labels, _sums(labels, self.g.k, self.top), np.bincount(labels, minlength=self.top)

    def quality(self) -> float:
        return self.g.quality(self.labels)

    def moves(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return best_moves(self.g, self.labels, who, self.tot, self.size)


class _ByRule(_Modularity):
    """The same under any criterion."""

    def __init__(self, g: Graph, labels: np.ndarray, rule: Rule):
        self.rule = rule
        loop = g.src == g.dst
        self.s = np.bincount(g.src[loop], g.w[loop], g.n)
        super().__init__(g, labels)

    def update(self, labels: np.ndarray) -> None:
        super().update(labels)
        inside = labels[self.g.src] == labels[self.g.dst]
        self.in_w = np.bincount(labels[self.g.src][inside], self.g.w[inside], self.top)
        self.cw = np.bincount(labels, self.g.node_w, self.top)
        self.tot = self.tot.astype(float)

    def quality(self) -> float:
        some = self.size > 0
        return self.rule.score(self.in_w[some], self.tot[some], self.cw[some])

    def moves(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v, c, e = _near(self.g, self.labels, who)
        if len(v) == 0:
            return v, c
        cur, size = self.labels[v], self.size
        own = np.zeros(self.g.n)
        mine = c == cur
        own[v[mine]] = e[mine]
        keep = ~mine & ((c < cur) | (size[c] > 1) | (size[cur] > 1))
        v, c, e, cur = v[keep], c[keep], e[keep], cur[keep]
        k, s, u, alone = self.g.k[v].astype(float), self.s[v], self.g.node_w[v].astype(float), size[cur] == 1
        kappa = (size > 0).sum() - alone
        left = [np.where(alone, 0.0, x) for x in (self.in_w[cur] - 2 * own[v] - s, self.tot[cur] - k, self.cw[cur] - u)]
        gain = self.rule.gain(e.astype(float), k, s, u, self.in_w[c], self.tot[c], self.cw[c], kappa) - self.rule.gain(own[v], k, s, u, *left, kappa)
        gain = np.round(gain, 9)
        good = gain > 0
        v, c, gain = v[good], c[good], gain[good]
        order = np.lexsort((c, -gain, v))
        v, c = v[order], c[order]
        first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
        return v[first], c[first]


def one_level(g: Graph, labels: np.ndarray, subset: np.ndarray | None, min_gain: float, max_passes: int, on_bad_pass: str = "keep", rule: Rule | None = None) -> tuple[np.ndarray, bool, int, float]:
    """(labels, whether a pass gained, passes, quality); without a rule under exact modularity."""
    bucket = bucket_of(g.degree)
    allowed = bucket > 0 if subset is None else (bucket > 0) & subset
    groups = [np.flatnonzero(allowed & (bucket == b)) for b in range(1, len(BUCKET_TOPS) + 2)]
    state = _Modularity(g, labels.copy()) if rule is None else _ByRule(g, labels.copy(), rule)
    q, improved, passes = state.quality(), False, 0
    while passes < max_passes:
        before, moved = state.labels.copy(), 0
        for who in groups:
            if len(who) == 0:
                continue
            v, c = state.moves(who)
            if len(v):
                state.labels[v] = c
                moved += len(v)
                state.update(state.labels)
        passes += 1
        new = state.quality()
        if new < q and on_bad_pass == "revert":
            return before, improved, passes, q
        improved |= new > q
        stop = new - q < min_gain or moved == 0
        q = new
        if stop:
            break
    return state.labels, improved, passes, q


def screen(g: Graph, labels: np.ndarray, v: np.ndarray, t: np.ndarray, added: bool) -> np.ndarray:
    """Mask of the vertices to re-evaluate after changed edges (v, t), given in both directions: as in operators.dynamic."""
    if added:
        who = np.unique(v)
        top = max(g.n, int(labels.max()) + 1)
        only = np.unique(v.astype(np.int64) * g.n + labels[t])
        marked, flagged = best_moves(g, labels, who, _sums(labels, g.k, top), np.bincount(labels, minlength=top), only) if len(who) else (who, who)
    else:
        same = labels[v] == labels[t]
        marked = np.unique(v[same])
        flagged = labels[marked]
    out = np.isin(labels, flagged)
    out[marked] = True
    near = np.zeros(g.n, bool)
    near[marked] = True
    out[g.dst[near[g.src]]] = True
    return out


def contract(g: Graph, labels: np.ndarray) -> tuple[Graph, np.ndarray]:
    """(graph of communities, numbered from 0 in ascending order of their ids; the new number of each vertex)."""
    ids, dense = np.unique(labels, return_inverse=True)
    n = len(ids)
    s, d = dense[g.src], dense[g.dst]
    key = s.astype(np.int64) * n + d
    order = np.argsort(key, kind="stable")
    key, w = key[order], g.w[order]
    if len(key) == 0:
        return Graph(n, key, key, w, _int_sums(dense, g.node_w, n)), dense
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return Graph(n, key[begin] // n, key[begin] % n, np.add.reduceat(w, begin), _int_sums(dense, g.node_w, n)), dense


def louvain(g: Graph, labels: np.ndarray | None = None, subset: np.ndarray | None = None, min_gain: float = 0.001, max_passes: int = 100, max_levels: int = 100, on_bad_pass: str = "keep", rule: Rule | None = None) -> tuple[list[np.ndarray], list[dict]]:
    """(for each level the community of each of its nodes, numbered densely; metrics of each level).

    With an initial partition the first level is contracted even without a gain.
    """
    levels, metrics, warm = [], [], labels is not None
    current = np.arange(g.n) if labels is None else labels
    for level in range(max_levels):
        current, improved, passes, q = one_level(g, current, subset if level == 0 else None, min_gain, max_passes, on_bad_pass, rule)
        nodes, arcs = g.n, len(g.src)
        smaller, dense = contract(g, current)
        metrics.append({"level": level, "nodes": nodes, "arcs": arcs, "passes": passes, "quality": q, "communities": smaller.n})
        levels.append(dense)
        if not improved and not (level == 0 and warm):
            break
        g, current = smaller, np.arange(smaller.n)
    return levels, metrics
