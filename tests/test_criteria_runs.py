"""Dynamic runs under all ten criteria against a twin in plain Python: dictionaries, one vertex at a time."""

import numpy as np
import pytest

from graphloom.functions import local_louvain, quality
from graphloom.plans import run
from graphloom.sources import tables

BUCKETS = (4, 8, 16, 32, 84, 319)


def over(a, b):
    return a / b if b else 0.0


class Twin:
    """Graph as {source: {target: weight}}, and the criterion's totals of the prepared start graph."""

    def __init__(self, which, n, edges):
        arcs = {v: {} for v in range(n)}
        for a, b in edges:
            arcs[a][b] = arcs[b][a] = 1
        self.which, self.n, self.extra = which, n, 0.0
        self.mx = max((w for t in arcs.values() for w in t.values()), default=1)
        if which == 4:
            for v in arcs:
                arcs[v].setdefault(v, 1)
            d = {v: len(t) for v, t in arcs.items()}
            loop = {v: t[v] for v, t in arcs.items()}
            new = {}
            for v, t in arcs.items():
                for u, w in t.items():
                    aux, tmp = 2 * w / (d[v] + d[u]), loop[v] / (2 * d[v]) + loop[u] / (2 * d[u])
                    new.setdefault(v, {})[u] = 2 * aux - tmp
                    self.extra += tmp - aux
            arcs = new
        if which == 7:
            d = {v: len(t) for v, t in arcs.items()}
            arcs = {v: {u: 2 * w / (d[v] + d[u]) for u, w in t.items()} for v, t in arcs.items()}
            self.extra = sum(w * w for t in arcs.values() for w in t.values())
        self.arcs = arcs
        self.m2 = sum(w for t in arcs.values() for w in t.values())

    def balance(self, a, b):
        return over(a * b, self.n * self.n * self.mx - self.m2)

    def score(self, stats):
        m2, n, mx, which = self.m2, self.n, self.mx, self.which
        scale = {0: m2, 3: n * mx, 4: n * n, 5: m2, 6: m2, 8: n}.get(which, n * n * mx)
        if not scale:
            return 0.0
        out = {1: n * n * mx - m2, 2: 0.5 * (n * n * mx - m2), 4: self.extra, 7: -self.extra}.get(which, 0.0)
        for i, t, w in stats:
            out += (
                over(i - over(t * t, m2), 1) if which == 0 else 2 * i - mx * w * w if which == 1 else i - 0.5 * mx * w * w if which == 2 else i / (2 * w) if which == 3 else i if which == 4
                else i - 2 * t * w / n + m2 / (n * n) * w * w if which == 5 else i - m2 / (n * n) * w * w if which == 6 else 2 * i / w - 1 if which == 7 else over(i, t) - 1 if which == 8
                else 2 * i - over(t * t, m2) - mx * w * w + self.balance(w * n * mx - t, n * w * mx - t)
            )
        return out / scale

    def gain(self, dnc, k, s, u, i, t, w, kappa):
        m2, n, mx, which = self.m2, self.n, self.mx, self.which
        ratio = lambda size, one, minus: over(2 * dnc + s, one) - minus if size == 0 else over(i + 2 * dnc + s, size + one) - i / size
        return (
            dnc - over(t * k, m2) if which == 0 else 2 * dnc - u * w * mx if which == 1 else dnc - 0.5 * u * w * mx if which == 2
            else ((2 * dnc + s) / (2 * u) if w == 0 else (i + 2 * dnc + s) / (2 * (w + u)) - i / (2 * w)) if which == 3 else dnc if which == 4
            else dnc - (t * u + k * w) / n + m2 * u * w / (n * n) if which == 5 else dnc - m2 * u * w / (n * n) if which == 6 else ratio(w, u, 0.5) if which == 7
            else (0.0 if kappa < 1 else ratio(t, k, 1.0)) if which == 8 else 2 * dnc - over(k * t, m2) - u * w * mx + self.balance(n * u * mx - k, n * w * mx - t)
        )

    def stats(self, arcs, size, labels):
        out = {}
        for v, c in labels.items():
            i, t, w, m = out.get(c, (0.0, 0.0, 0, 0))
            inside = sum(x for u, x in arcs[v].items() if labels[u] == c)
            out[c] = (i + inside, t + sum(arcs[v].values()), w + size[v], m + 1)
        return out

    def level(self, arcs, size, labels, subset):
        q, improved = self.score([x[:3] for x in self.stats(arcs, size, labels).values()]), False
        bucket = {v: sum(len(t) > b for b in BUCKETS) for v, t in arcs.items() if t}
        for _ in range(100):
            before, moved = dict(labels), False
            for b in range(len(BUCKETS) + 1):
                stats, moves = self.stats(arcs, size, labels), {}
                for v in [v for v, x in bucket.items() if x == b and (subset is None or v in subset)]:
                    near = {}
                    for u, w in arcs[v].items():
                        if u != v:
                            near[labels[u]] = near.get(labels[u], 0) + w
                    own, k, s = labels[v], sum(arcs[v].values()), arcs[v].get(v, 0)
                    i, t, w, m = stats[own]
                    kappa = len(stats) - (m == 1)
                    e = near.pop(own, 0)
                    stay = self.gain(e, k, s, size[v], *((0, 0, 0) if m == 1 else (i - 2 * e - s, t - k, w - size[v])), kappa)
                    best = max(((round(self.gain(x, k, s, size[v], *stats[c][:3], kappa) - stay, 9), -c) for c, x in near.items() if c < own or stats[c][3] > 1 or m > 1), default=(0, 0))
                    if best[0] > 0:
                        moves[v] = -best[1]
                moved |= bool(moves)
                labels.update(moves)
            new = self.score([x[:3] for x in self.stats(arcs, size, labels).values()])
            if new < q and self.which:
                return before, improved, q
            improved |= new > q
            stop = new - q < 0.001 or not moved
            q = new
            if stop:
                break
        return labels, improved, q

    def detect(self, labels=None, subset=None):
        arcs, size, warm = self.arcs, {v: 1 for v in self.arcs}, labels is not None
        current, flat = dict(labels) if warm else {v: v for v in arcs}, {v: v for v in arcs}
        for level in range(100):
            current, improved, q = self.level(arcs, size, current, subset if level == 0 else None)
            dense = {c: i for i, c in enumerate(sorted(set(current.values())))}
            flat = {v: dense[current[x]] for v, x in flat.items()}
            smaller, weights = {i: {} for i in dense.values()}, dict.fromkeys(dense.values(), 0)
            for v, t in arcs.items():
                weights[dense[current[v]]] += size[v]
                for u, w in t.items():
                    a, b = dense[current[v]], dense[current[u]]
                    smaller[a][b] = smaller[a].get(b, 0) + w
            if not improved and not (level == 0 and warm):
                break
            arcs, size, current = smaller, weights, {v: v for v in smaller}
        return flat, q


def on_arrays(twin, labels, subset):
    """The same through the array kernel."""
    arcs = [(v, u, float(w)) for v, t in twin.arcs.items() for u, w in t.items()]
    src, dst, w = (np.array([a[i] for a in arcs], (np.int64, np.int64, float)[i]) for i in range(3))
    g = local_louvain.Graph(twin.n, src, dst, w)
    rule = local_louvain.Rule(twin.which, twin.m2, twin.n, twin.mx, twin.extra)
    start = None if labels is None else np.array([labels[v] for v in range(twin.n)])
    mask = None if subset is None else np.array([v in subset for v in range(twin.n)])
    levels, metrics = local_louvain.louvain(g, start, mask, on_bad_pass="revert" if twin.which else "keep", rule=rule)
    flat = np.arange(twin.n)
    for dense in levels:
        flat = dense[flat]
    return dict(enumerate(flat.tolist())), metrics[-1]["quality"]


def toy_run(which, mode, detect):
    """[(op, size of R, quality, partition)] over the toy graph's steps, with the sequential screens."""
    edges, labels, out = {tuple(sorted(e)) for e in tables.TOY_EDGES}, None, []
    n = 1 + max(map(max, edges))
    twin = Twin(which, n, edges)
    labels, q = detect(twin, None, None)
    out.append(("start", n, q, blocks(labels)))
    for step in (0, 1):
        for op in ("del", "add"):
            batch = {tuple(sorted(e[2:])) for e in tables.TOY_CHANGES if e[:2] == (step, op)}
            if op == "del":
                batch &= edges
                edges -= batch
                marks = {v: labels[v] for e in batch if labels[e[0]] == labels[e[1]] for v in e}
                r = {v for v, c in labels.items() if c in set(marks.values())}
                r |= {u for v, c in marks.items() for e in edges if v in e for u in e if labels[u] != c}
            else:
                edges |= batch
                old, n = n, 1 + max(map(max, edges))
                fresh = max(labels.values()) + 1
                known = dict(labels)
                for v in range(old, n):
                    ends = [e[0] if e[1] == v else e[1] for e in edges if v in e]
                    if len(ends) == 1 and ends[0] in known:
                        labels[v] = known[ends[0]]
                    else:
                        labels[v], fresh = fresh, fresh + 1
                r = {v for e in batch if labels[e[0]] != labels[e[1]] for v in e}
            twin = Twin(which, n, edges)
            if mode != "delta" or r:
                labels, q = detect(twin, None if mode == "static" else labels, r if mode == "delta" else None)
            else:
                q = twin.score([x[:3] for x in twin.stats(twin.arcs, dict.fromkeys(twin.arcs, 1), labels).values()])
            out.append((op, len(r) if mode == "delta" else n, q, blocks(labels)))
    return out


def blocks(labels):
    out = {}
    for v, c in labels.items():
        out.setdefault(c, set()).add(v)
    return {frozenset(b) for b in out.values()}


@pytest.mark.parametrize("mode", run.MODES)
@pytest.mark.parametrize("which", range(10))
def test_array_runs_match_the_twin(which, mode):
    mine, theirs = toy_run(which, mode, on_arrays), toy_run(which, mode, lambda t, labels, r: t.detect(labels, r))
    for a, b in zip(mine, theirs, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9) and a[3] == b[3]


@pytest.mark.parametrize(("which", "mode"), [(1, "delta"), (4, "static"), (7, "full")])
def test_runs_match_the_twin(spark, which, mode):
    """run_steps under the criterion: screened vertices, qualities, and the partitions that each step hands out."""
    seen = []
    arcs, nodes = run.load_graph(tables.toy_edges(spark))
    *_, reports = run.run_steps(arcs, nodes, tables.toy_changes(spark), 1, mode, criterion=which, on_step=lambda r, labels: seen.append(blocks({x["id"]: x["comm"] for x in labels.collect()})))
    for r, got, (op, size, q, partition) in zip(reports, seen, toy_run(which, mode, lambda t, labels, r: t.detect(labels, r)), strict=True):
        assert (r.op, r.r_size) == (op, size) and r.quality == pytest.approx(q, abs=1e-8) and got == partition


@pytest.mark.parametrize("which", [8])
def test_dataframe_levels_match_the_twin(spark, which):
    """The same as DataFrame jobs, warm and restricted to some vertices."""
    edges = {tuple(sorted(e)) for e in tables.TOY_EDGES}
    twin = Twin(which, 14, edges)
    start, subset = {v: v - v % 2 for v in range(14)}, {0, 1, 2, 5, 6, 11}
    arcs, nodes = run.load_graph(tables.toy_edges(spark))
    got = run.detect(arcs, nodes, spark.createDataFrame(list(start.items()), "id long, comm long"), spark.createDataFrame([(v,) for v in subset], "id long"), criterion=which, local_arcs=0)
    flat, q = twin.detect(start, subset)
    assert got.quality == pytest.approx(q, abs=1e-8) and blocks({r["id"]: r["comm"] for r in got.labels.collect()}) == blocks(flat)
    assert quality.score(which, arcs, nodes, got.labels).first()["q"] == pytest.approx(q, abs=1e-8)
