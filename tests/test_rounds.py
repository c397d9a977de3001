"""Methods by rounds: the same rows as in tasks, and size estimates that don't grow from round to round."""

import random

import pytest

import __spark_entry__ as entry
from tagmill.operators import dedup, graphs

SF = "/root/testdata/sf0.001"
#: Digits of the estimate of a plan over settled tables: one long a table, and a few joins.
DIGITS = 1000


def digits(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() * 3 // 10


@pytest.mark.parametrize("limit", [1, 1000, dedup.LOCAL_ARCS])
def test_long_paths(spark, monkeypatch, limit):
    """Paths of 64 nodes of one read: each belongs to its first node, by rounds, in more groups and in those of small graphs."""
    names = list(range(640))
    random.Random(5).shuffle(names)
    paths = [names[i : i + 64] for i in range(0, 640, 64)]
    nodes = spark.createDataFrame([(1, "A", 1, n) for n in names], "key int, umi string, cnt long, node long")
    edges = spark.createDataFrame([e for p in paths for e in zip(p, p[1:], strict=False)], "src long, dst long")
    monkeypatch.setattr(dedup, "LOCAL_ARCS", limit)
    groups = dedup._groups(graphs.with_components(nodes, edges), dedup.directed(nodes, edges))
    assert groups == {1: 0, 1000: 2 * dedup.GROUPS}.get(limit, dedup.GROUPS)
    found = dedup.directional(nodes, edges, ["key"])
    assert digits(found) < DIGITS
    assert {r["node"]: r["rep"] for r in found.collect()} == {n: min(p) for p in paths for n in p}


@pytest.mark.parametrize("name", ["b10_marked_reads", "e16_trace_table", "e21_representative_matches", "e7_distance_bins", "j4_trace", "b12_representative_map", "e21_edge_classes", "g4_removed_nodes", "j4_directional", "j5_starsolo", "b1_kept_reads", "e21_edge_shares", "e6_weighted_distance", "j4_directional_count", "k2_sweep"])
def test_queries_by_rounds(spark, monkeypatch, name):
    run = entry.queries()[name]
    expected = sorted(map(tuple, run(spark, SF).collect()))
    monkeypatch.setattr(dedup, "LOCAL_ARCS", 1)
    found = run(spark, SF)
    assert digits(found) < DIGITS
    assert sorted(map(tuple, found.collect())) == expected
