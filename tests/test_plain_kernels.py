"""Kernels and the queries over them against plain versions, group by group."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tagmill.fixtures import reads
from tagmill.operators import counting, graphs, local
from tagmill.operators import kernels as K
from tagmill.registry_reads import QUERIES

SF = "/root/testdata/sf0.001"


def dense_markov(n, pairs, inflation=1.6, expansion=2, iterations=100, prune=1e-3):
    """Markov clusters with full matrices."""
    m = np.eye(n)
    for a, b in pairs:
        m[a, b] = m[b, a] = 1
    m = m / m.sum(axis=0)
    for _ in range(iterations):
        before = m
        m = np.linalg.matrix_power(m, expansion) ** inflation
        m = m / m.sum(axis=0)
        for j in range(n):
            top = m[:, j].argmax()
            m[:, j] = [v if v >= prune or i == top else 0 for i, v in enumerate(m[:, j])]
        m = m / m.sum(axis=0)
        if np.allclose(m, before):
            break
    return sorted({tuple(np.flatnonzero(m[i]).tolist()) for i in range(n) if m[i, i] > 0})


@pytest.mark.parametrize(("expansion", "products"), [(2, 1 << 21), (3, 1 << 21), (2, 50)])
def test_sparse_markov_clusters_are_the_dense_ones(monkeypatch, expansion, products):
    monkeypatch.setattr(K, "PRODUCTS", products)
    rng = random.Random(expansion)
    for _ in range(60):
        n = rng.randint(1, 25)
        pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))) if a < b}
        src, dst = (np.array([p[i] for p in sorted(pairs)], np.int64) for i in (0, 1))
        got = K.markov_clusters(n, src, dst, expansion=expansion)
        assert sorted(map(tuple, got)) == dense_markov(n, pairs, expansion=expansion)


def test_markov_clusters_of_a_large_component():
    cliques = 1_000  # of five nodes, each joined to the next by one edge: a full matrix would have 200 MB
    inside = [(5 * c + i, 5 * c + j) for c in range(cliques) for i in range(5) for j in range(i)]
    between = [(5 * c, 5 * c + 6) for c in range(cliques - 1)]
    src, dst = np.array(inside + between).T
    assert sorted(K.markov_clusters(5 * cliques, src, dst)) == [list(range(5 * c, 5 * c + 5)) for c in range(cliques)]


def plain_cover(multimers, k=3, mode="vote"):
    left, out = set(multimers), []
    while True:
        covers = defaultdict(set)
        for m in left:
            for mono in K.monomers(m, k, mode):
                covers[mono].add(m)
        best = min(covers, key=lambda mono: (-len(covers[mono]), mono), default=None)
        if best is None or len(covers[best]) < 2:
            return out + [[m] for m in sorted(left)]
        out.append(sorted(covers[best]))
        left -= covers[best]


@pytest.mark.parametrize("mode", ["vote", "all"])
def test_set_cover_is_the_plain_one(mode):
    rng = random.Random(3)
    for _ in range(40):
        multimers = list({"".join(rng.choice("AC") * 2 + rng.choice("ACG") for _ in range(3)) for _ in range(rng.randint(1, 30))})
        assert K.set_cover(multimers, 3, mode) == plain_cover(multimers, 3, mode)


def test_expectation_maximisation_is_the_plain_one():
    rng = random.Random(4)
    for _ in range(30):
        table = [{f: float(n) for f in rng.sample("abcdef", rng.randint(2, 4))} for n in rng.choices(range(1, 9), k=rng.randint(1, 6))]
        names, total = sorted({f for r in table for f in r}), sum(max(r.values()) for r in table)
        w, last = dict.fromkeys(names, 1 / len(names)), -np.inf
        for _ in range(100):
            got, loglik = dict.fromkeys(names, 0.0), 0.0
            for r in table:
                n, own = max(r.values()), sum(w[f] for f in r)
                loglik += n * np.log(own)
                for f in r:
                    got[f] += n * w[f] / own
            w = {f: v / total for f, v in got.items()}
            if abs(loglik - last) < 1e-5:
                break
            last = loglik
        want = {f: v * total for f, v in w.items()}
        assert K.redistribute(table) == pytest.approx(want)


@pytest.fixture(scope="module")
def parts(spark):
    """Nodes by gene, and the components of each gene as node lists with the edges inside, ranked."""
    nodes = graphs.settle(graphs.build_nodes(reads(spark, SF), ["gene"]))
    edges = [(r["src"], r["dst"]) for r in graphs.build_edges(nodes, ["gene"], 1).collect()]
    rows = sorted(nodes.collect(), key=lambda r: (-r["cnt"], r["node"]))
    root = {r["node"]: r["node"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    by_gene = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by_gene[r["gene"]][find(r["node"])].append(r)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return by_gene, near


def inner(own, near):
    at = {r["node"]: i for i, r in enumerate(own)}
    return sorted({(min(i, at[n]), max(i, at[n])) for r, i in zip(own, range(len(own)), strict=True) for n in near[r["node"]] if n in at})


def markov_labels(own, near):
    label = {}
    for k, members in enumerate(dense_markov(len(own), inner(own, near))):
        for i in members:
            label[i] = k
    return label


def expected(by_gene, count):
    return {gene: sum(count(own) for own in comps.values()) for gene, comps in by_gene.items()}


def found(spark, name):
    return {r["gene"]: r["dedup_cnt"] for r in QUERIES[name](spark, SF).collect()}


def test_markov_queries_are_the_plain_ones(spark, parts):
    by_gene, near = parts
    want = expected(by_gene, lambda own: len(set(markov_labels(own, near).values())))
    assert found(spark, "j11_mcl") == want
    whole = {g: len(set(markov_labels(sorted((r for c in comps.values() for r in c), key=lambda r: (-r["cnt"], r["node"])), near).values())) for g, comps in by_gene.items()}
    assert found(spark, "j14_mcl_whole_group") == whole

    def merged(link):
        def count(own):
            label = markov_labels(own, near)
            reps = sorted({min(i for i in label if label[i] == k) for k in set(label.values())})
            root = {r: r for r in reps}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a in reps:
                for b in reps:
                    if a < b and link(own[a], own[b]):
                        root[find(a)] = find(b)
            return len({find(r) for r in reps})

        return count

    apart = lambda a, b: a["cnt"] > 2 * b["cnt"] - 1 or b["cnt"] > 2 * a["cnt"] - 1
    assert found(spark, "j12_mcl_val") == expected(by_gene, merged(apart))
    close = lambda a, b: sum(x != y for x, y in zip(a["umi"], b["umi"], strict=True)) <= 1
    assert found(spark, "j13_mcl_ed") == expected(by_gene, merged(close))


def test_classic_merges_are_the_plain_ones(spark, parts):
    by_gene, near = parts

    def count(own):
        alive = {i: r["cnt"] for i, r in enumerate(own)}
        for u, v in inner(own, near):
            if u in alive and v in alive:
                low, high = (u, v) if alive[u] <= alive[v] else (v, u)
                alive[high] += alive.pop(low)
        return len(alive)

    assert found(spark, "j19_dropest_classic") == expected(by_gene, count)


def test_set_cover_query_is_the_plain_one(spark):
    from tagmill.registry import _trimers

    groups = defaultdict(set)
    for r in _trimers(spark, SF).collect():
        groups[r["g"]].add(r["umi"])
    want = {g: (len(plain_cover(sorted(m))), len(m)) for g, m in groups.items()}
    assert {r["g"]: (r["dedup_cnt"], r["multimers"]) for r in QUERIES["j16_set_cover"](spark, SF).collect()} == want


def test_class_molecules_and_counts_are_the_plain_ones(spark):
    from tagmill.registry import _features

    classes = graphs.settle(counting.equivalence_classes(_features(spark, SF).where("cell < 2")))
    arcs = graphs.settle(counting.class_arcs(classes))
    rows = {r["node"]: r for r in classes.collect()}
    out = defaultdict(set)
    want_arcs = set()
    for a in rows.values():
        for b in rows.values():
            near = sum(x != y for x, y in zip(a["umi"], b["umi"], strict=True)) <= 1
            if a["node"] != b["node"] and a["cell"] == b["cell"] and near and set(a["features"]) & set(b["features"]) and a["cnt"] >= 2 * b["cnt"] - 1:
                out[a["node"]].add(b["node"])
                want_arcs.add((a["node"], b["node"]))
    assert {(r["src"], r["dst"]) for r in arcs.collect()} == want_arcs
    into = {b for _, b in want_arcs}

    def reach(u):
        seen, stack = {u}, [u]
        while stack:
            x = stack.pop()
            for v in out[x] - seen:
                if set(rows[v]["features"]) & set(rows[u]["features"]):
                    seen.add(v)
                    stack.append(v)
        return seen

    left, want = set(rows), []
    for u in sorted(rows, key=lambda u: (u in into, -len(reach(u)), -rows[u]["cnt"], u)):
        if u in left:
            own = reach(u) & left
            common = set.intersection(*(set(rows[n]["features"]) for n in own))
            want.append((rows[u]["cell"], u, tuple(sorted(common or rows[u]["features"]))))
            left -= own
    molecules = graphs.settle(counting.class_molecules(classes, arcs))
    assert sorted((r["cell"], r["parent"], tuple(r["features"])) for r in molecules.collect()) == sorted(want)
    total = {r["cell"]: 0.0 for r in rows.values()}
    for r in counting.redistributed(molecules).collect():
        total[r["cell"]] += r["counts"]
    assert total == pytest.approx({c: sum(w[0] == c for w in want) for c in total}, abs=1e-3)


def test_density_clusters_with_cores_are_the_plain_ones():
    rng = random.Random(6)
    for _ in range(20):
        umis = list({"".join(rng.choice("ACG") for _ in range(4)) for _ in range(rng.randint(1, 30))})
        x, least = K.one_hot(umis), rng.randint(1, 4)
        near = [[j for j, v in enumerate(umis) if 2 * sum(a != b for a, b in zip(u, v, strict=True)) <= 1.5**2] for u in umis]
        cores = {i for i, n in enumerate(near) if len(n) >= least}
        label = np.asarray(K.dbscan(x, 1.5, least))
        for i in range(len(umis)):
            if i in cores:
                assert label[i] >= 0 and all(label[j] == label[i] for j in near[i] if j in cores)
            else:
                assert label[i] == -1 if not set(near[i]) & cores else label[i] in {label[j] for j in near[i] if j in cores}
        assert local.K is K
