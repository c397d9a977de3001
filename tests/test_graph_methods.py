"""Worked graphs with known clusters, and random graphs against plain implementations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.graph import components
from tagmill.operators import dedup, graphs, local, summary
from tagmill.plans.pipeline import Dedup

COUNTS = {"A": 120, "B": 2, "C": 2, "D": 90, "E": 50, "F": 1, "G": 5}
UMIS = {"A": "AGATCTCGCA", "B": "AGATCCCGCA", "C": "AGATCACGCA", "D": "AGATCGCGCA", "E": "AGATCGCGGA", "F": "AGATCGCGTA", "G": "TGATCGCGAA"}
EDGES = "AB AC AD BC DE DF EG FG"
NAMES = list(COUNTS)


@pytest.fixture(scope="module")
def g7(spark):
    nodes = spark.createDataFrame([(1, UMIS[n], COUNTS[n], i) for i, n in enumerate(NAMES)], "key int, umi string, cnt long, node long")
    edges = spark.createDataFrame([(NAMES.index(e[0]), NAMES.index(e[1])) for e in EDGES.split()], "src long, dst long")
    return nodes, edges


def clusters(assignment):
    out = {}
    for r in assignment.collect():
        out.setdefault(NAMES[r["rep"]], []).append(NAMES[r["node"]])
    return sorted("".join(sorted(v)) for v in out.values())


@pytest.mark.parametrize(
    ("method", "expected"),
    [
        ("unique", list("ABCDEFG")),
        ("cluster", ["ABCDEFG"]),
        ("adjacency", ["ABC", "DF", "EG"]),
        ("directional", ["ABC", "DF", "EG"]),
        ("greedy", ["ABCD", "EG", "F"]),
        ("greedy_directional", ["ABC", "DF", "EG"]),
        ("greedy_singleton", ["A", "B", "C", "DF", "E", "G"]),
    ],
)
def test_worked_graph(g7, method, expected):
    got = clusters(dedup.METHODS[method](*g7, ["key"]))
    if method == "adjacency":
        assert len(got) == 3 and "ABC" in got
    elif method == "greedy":
        assert "ABCD" in got and len(got) == 3
    else:
        assert got == expected


def test_trace(g7):
    nodes, edges = g7
    rows = dedup.trace(dedup.directional(nodes, edges, ["key"]), nodes, edges).where("approved").collect()
    assert sorted(NAMES[r["src"]] + NAMES[r["dst"]] for r in rows) == ["AB", "AC", "DF", "EG"]


def test_markov(g7):
    assert clusters(local.mcl(*g7, ["key"])) == ["ABC", "DEFG"]
    assert clusters(local.mcl_val(*g7, ["key"], t=2)) == ["ABC", "DEFG"]
    assert clusters(local.mcl_val(*g7, ["key"], t=1)) == ["ABCDEFG"]
    assert clusters(local.mcl_ed(*g7, ["key"], t=1)) == ["ABCDEFG"]
    assert clusters(local.mcl_ed(*g7, ["key"], t=0)) == ["ABC", "DEFG"]


def test_points(g7):
    nodes, edges = g7
    assert len(clusters(local.point_clusters(nodes, edges, ["key"], "dbscan", eps=1.5, min_samples=1))) == 2
    assert len(clusters(local.point_clusters(nodes, edges, ["key"], "birch", threshold=1.8))) == 1
    assert len(clusters(local.dbscan_components(nodes, ["key"]))) == 2


def test_paper_graph(spark):
    counts, names = {"A": 456, "E": 90, "D": 72, "B": 2, "C": 2, "F": 1}, list("ABCDEF")
    nodes = spark.createDataFrame([(1, n, counts[n], i) for i, n in enumerate(names)], "key int, umi string, cnt long, node long")
    edges = spark.createDataFrame([(names.index(a), names.index(b)) for a, b in "AB AC AD BC DE DF".split()], "src long, dst long")
    assert sorted(r["rep"] for r in dedup.directional(nodes, edges, ["key"]).select("rep").distinct().collect()) == [0, 4]
    assert dedup.adjacency(nodes, edges, ["key"]).where("node = rep").count() == 3


def test_random_graphs(spark):
    rng = random.Random(5)
    rows, links, truth = [], [], {}
    for g in range(25):
        n = rng.randint(1, 9)
        ids = [g * 100 + i for i in range(n)]
        cnt = {i: rng.choice([1, 1, 2, 3, 8, 20]) for i in ids}
        own = [(a, b) for a in ids for b in ids if a < b and rng.random() < 0.35]
        near = {i: {b for a, b in own if a == i} | {a for a, b in own if b == i} for i in ids}
        rows += [(g, f"u{i}", cnt[i], i) for i in ids]
        links += own
        order, taken, reps = sorted(ids, key=lambda i: (-cnt[i], i)), {}, 0
        for u in order:  # depth-first absorption by rank
            if u not in taken:
                reps, stack, taken[u] = reps + 1, [u], u
                while stack:
                    x = stack.pop()
                    for v in near[x]:
                        if v not in taken and cnt[x] >= 2 * cnt[v] - 1:
                            taken[v] = u
                            stack.append(v)
        truth |= taken
    nodes = spark.createDataFrame(rows, "key int, umi string, cnt long, node long")
    edges = spark.createDataFrame(links, "src long, dst long")
    got = {r["node"]: r["rep"] for r in dedup.directional(nodes, edges, ["key"]).collect()}
    assert got == truth


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()}
    for x in {x for e in edges for x in e}:
        assert got.get(x, x) == find(x)
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_summary_and_marks(spark):
    reads = spark.createDataFrame([(0, "k", "AAAA"), (1, "k", "AAAA"), (2, "k", "AAAA"), (3, "k", "AAAT"), (4, "k", "GGGG"), (5, "l", "CCCC")], "id long, key string, umi string")
    nodes = graphs.build_nodes(reads, ["key"])
    edges = graphs.build_edges(nodes, ["key"], 1)
    a = dedup.directional(nodes, edges, ["key"])
    rows = {r["key"]: r for r in summary.summarize(a, ["key"]).collect()}
    assert tuple(rows["k"])[1:] == (2, 4.0, 3, 1, 1)
    assert tuple(rows["l"])[1:] == (1, -1.0, 1, 0, 0)
    marks = {r["id"]: (r["UMI_mapped"], r["PD"]) for r in summary.mark(reads, a, ["key"]).collect()}
    assert marks == {0: ("AAAA", 0), 1: ("AAAA", 1), 2: ("AAAA", 1), 3: ("AAAA", 1), 4: ("GGGG", 0), 5: ("CCCC", 0)}
    assert sorted(r["id"] for r in summary.kept_reads(reads, a).collect()) == [0, 4, 5]


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("rule", ["eq", "le"])
def test_edges_of_mixed_lengths(spark, k, rule):
    rng = random.Random(k)
    umis = sorted({"".join(rng.choice("AC") for _ in range(rng.choice([1, 2, 4, 5]))) for _ in range(40)})
    nodes = spark.createDataFrame([("k", u, 1, i) for i, u in enumerate(umis)], "key string, umi string, cnt long, node long")
    got = {(r["src"], r["dst"]) for r in graphs.build_edges(nodes, ["key"], k, rule).collect()}
    want = set()
    for i, a in enumerate(umis):
        for j in range(i + 1, len(umis)):
            if len(a) == len(umis[j]):
                d = sum(x != y for x, y in zip(a, umis[j], strict=True))
                if d == k or rule == "le" and d <= k:
                    want.add((i, j))
    assert got == want


def bayes_by_force(rows, bins=10, threshold=0.9):
    """node: rep, by comparing all barcodes of a group in every round."""
    groups = {}
    for key, umi, cnt, node, qual in rows:
        groups.setdefault(key, {})[umi] = (cnt, qual, node)

    def directed(live, counts, quals):
        for i, u in enumerate(sorted(live)):
            for v in sorted(live)[i + 1 :]:
                if len(u) == len(v) and sum(x != y for x, y in zip(u, v, strict=True)) == 1:
                    swap = counts[u] > counts[v] or counts[u] == counts[v] and quals[u] > quals[v]
                    b, t = (v, u) if swap else (u, v)
                    yield b, t, quals[b], counts[b] / max(counts[t], 1), counts[b], counts[t]

    split = {k: ({u: x[0] for u, x in g.items()}, {u: x[1] for u, x in g.items()}) for k, g in groups.items()}
    seen = [p for counts, quals in split.values() for p in directed(set(counts), counts, quals)]
    y = np.array([int((r <= 0.2 or c <= 2 and t >= 4) and not (r >= 0.5 and c >= 3 and t >= 3)) for *_, r, c, t in seen])
    borders = [np.unique(np.quantile([p[i] for p in seen], np.linspace(0, 1, bins + 1)[1:-1])) for i in (2, 3, 4)]
    tables = [np.array([[1 + sum(np.digitize(p[i], b) == k and y[n] == c for n, p in enumerate(seen)) for k in range(len(b) + 1)] for c in (0, 1)], float) for i, b in zip((2, 3, 4), borders, strict=True)]
    prior = [np.mean(y == c) or 0.5 for c in (0, 1)]

    def posterior(pair):
        p = [np.log(prior[c]) + sum(np.log(t[c, np.digitize(pair[i], b)] / t[c].sum()) for i, b, t in zip((2, 3, 4), borders, tables, strict=True)) for c in (0, 1)]
        return 1 / (1 + np.exp(p[0] - p[1]))

    out = {}
    for key, (counts, quals) in split.items():
        live, rep = set(counts), {u: u for u in counts}
        for _ in range(100):
            bar = min(threshold + 0.05 * np.log1p(len(live)), 0.99)
            good = sorted((p for p in directed(live, dict(counts), quals) if posterior(p) >= bar), key=lambda p: (-p[5], p[3], p[2]))
            if not good:
                break
            for b, t, *_ in good:
                if b in live and t in live:
                    counts[t] += counts[b]
                    rep[b] = t
                    live.remove(b)
        for u in rep:
            end = u
            while rep[end] != end:
                end = rep[end]
            out[groups[key][u][2]] = groups[key][end][2]
    return out


def test_bayes_merges(spark):
    rng = random.Random(7)
    rows, near = [], lambda u: (lambda i: u[:i] + rng.choice("ACGT") + u[i + 1 :])(rng.randrange(len(u)))
    for g in range(60):
        true = ["".join(rng.choice("ACGT") for _ in range(6)) for _ in range(rng.choice([1, 1, 2, 4, 12]))]
        own = {u: (rng.choice([3, 9, 9, 30, 60, 100]), float(rng.randint(30, 38))) for u in true}
        for u in true:
            for _ in range(rng.randint(0, 4)):
                own.setdefault(near(rng.choice([u, near(u)])), (rng.choice([1, 1, 1, 2, 3, 12]), float(rng.choice([12, 14, 20, 33]))))
        rows += [(g, u, c, 100 * g + i, q) for i, (u, (c, q)) in enumerate(sorted(own.items()))]
    nodes = spark.createDataFrame(rows, "key int, umi string, cnt long, node long, quality double")
    edges = graphs.build_edges(nodes, ["key"], 1)
    want = bayes_by_force(rows)
    got = {r["node"]: r["rep"] for r in local.bayes_merge(nodes, edges, ["key"]).collect()}
    assert got == want and len(want) / 9 < sum(a != b for a, b in want.items()) < len(want) / 2
    # the quality counts, and barcodes of similar counts stay
    level = nodes.withColumn("quality", F.lit(30.0))
    assert {r["node"]: r["rep"] for r in local.bayes_merge(level, edges, ["key"]).collect()} == bayes_by_force([(*r[:4], 30.0) for r in rows]) != want
    alike = spark.createDataFrame([(1, "AAAA", 4, 1), (1, "AAAT", 8, 2)], "key int, umi string, cnt long, node long")
    assert local.bayes_merge(alike, graphs.build_edges(alike, ["key"], 1), ["key"]).where("node = rep").count() == 2


def test_bayes_merges_use_read_quality(spark):
    reads = spark.createDataFrame([(1, "k", "AAAA", 20), (2, "k", "AAAA", 30), (3, "k", "AAAT", None)], "id long, key string, umi string, qual int")
    rows = {r["umi"]: r["quality"] for r in graphs.build_nodes(reads, ["key"], quality="qual").collect()}
    assert rows == {"AAAA": 25.0, "AAAT": None}
    assert Dedup(reads, ["key"]).assign("dropest").count() == 2
