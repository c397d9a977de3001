"""Deduplication methods on nodes (keys, umi, cnt, node) and edges (src, dst).

Every method returns an assignment: keys, node, umi, cnt, cc, rep, where rep is the node
that stands for the node's molecule. ``members`` of adjacency and set cover may overlap
in the literature's form; here a node belongs to its lowest-ranked representative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.operators.graphs import both_ways, settle, with_components


#: Arcs up to this number are walked in GROUPS groups of whole components, a task each; more get
#: more groups, none of which may have over half of it in nodes and arcs.
LOCAL_ARCS = 1 << 22
GROUPS = 64


def _columns(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "node", "umi", "cnt", "cc", "rep")


def unique(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every distinct barcode is a molecule."""
    return _columns(nodes.withColumn("cc", F.col("node")).withColumn("rep", F.col("node")), keys)


def cluster(nodes: DataFrame, edges: DataFrame, keys: list[str], tie: str = "node") -> DataFrame:
    """A molecule for each connected component, named by its most frequent barcode."""
    df = with_components(nodes, edges)
    best = df.groupBy("cc").agg(F.min_by("node", F.struct(-F.col("cnt"), tie)).alias("rep"))
    return _columns(df.join(best, "cc"), keys)


def _rank(tie: str):
    """What a node's rank in its component goes by; smaller is better."""
    return F.struct((-F.col("cnt")).alias("c"), F.col(tie).alias("t"), F.col("node").alias("node"))


def adjacency(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Barcodes are popped by rank until they and their neighbours cover the component.

    The last one popped is the worst, over nodes, of the better of a node and its best
    neighbour. A node that isn't popped belongs to its best neighbour. Ranks are compared,
    never numbered, so no component is sorted in one task.
    """
    df = settle(with_components(nodes, edges).withColumn("r", _rank("node")))
    near = both_ways(edges).join(df.select(F.col("node").alias("src"), F.col("r").alias("near")), "src").groupBy("dst").agg(F.min("near").alias("near"))
    df = df.join(near.withColumnRenamed("dst", "node"), "node", "left")
    popped = df.groupBy("cc").agg(F.max(F.least("r", F.coalesce("near", "r"))).alias("popped"))
    df = df.join(popped, "cc")
    return _columns(df.withColumn("rep", F.when(F.col("r") <= F.col("popped"), F.col("node")).otherwise(F.col("near.node"))), keys)


def _arcs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, cnt_src, cnt_dst of every edge both ways; counts are looked up only if the edges have none."""
    if {"cnt_src", "cnt_dst"} <= set(edges.columns):
        ends = ("src", "dst", "cnt_src", "cnt_dst")
        return edges.select(*ends).unionByName(edges.select(*(F.col(b).alias(a) for a, b in zip(ends, ("dst", "src", "cnt_dst", "cnt_src"), strict=True))))
    counts = nodes.select("node", "cnt")
    return both_ways(edges).join(counts.withColumnsRenamed({"node": "src", "cnt": "cnt_src"}), "src").join(counts.withColumnsRenamed({"node": "dst", "cnt": "cnt_dst"}), "dst")


def directed(nodes: DataFrame, edges: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Edges u -> v with cnt(u) >= ratio * cnt(v) - 1, with both counts."""
    return _arcs(nodes, edges).where(F.col("cnt_src") >= ratio * F.col("cnt_dst") - 1)


def directional(nodes: DataFrame, edges: DataFrame, keys: list[str], tie: str = "node", ratio: float = 2.0) -> DataFrame:
    """The representative of a node is the best-ranked node that reaches it over directed edges.

    Labels go along the edges and through each other (what reaches a node's label reaches
    the node), so rounds are about the logarithm of the longest path.
    """
    df, arcs = with_components(nodes, edges), directed(nodes, edges, ratio).select("src", "dst")
    if groups := _groups(df, arcs):
        return _columns(df.join(_in_tasks(df, arcs, tie, _reach, groups), "node"), keys)
    df, arcs = settle(df), settle(arcs)
    labels = _by_rounds(settle(df.select("node", _rank(tie).alias("label"))), arcs)
    return _columns(df.join(labels.select("node", F.col("label.node").alias("rep")), "node"), keys)


def _by_rounds(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """The least label that reaches each node."""
    while True:
        along = arcs.join(labels.select(F.col("node").alias("src"), F.col("label").alias("via")), "src").groupBy("dst").agg(F.min("via").alias("via"))
        step = labels.join(along.withColumnRenamed("dst", "node"), "node", "left").withColumn("next", F.least("label", "via"))
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("far"))
        step = step.join(jump, F.col("next.node") == F.col("at")).select("node", "label", F.least("next", "far").alias("next"))
        step = settle(step)
        done = step.where("label <> next").isEmpty()
        labels = step.select("node", F.col("next").alias("label"))
        if done:
            return labels


def _group(groups: int) -> Column:
    """The group that a node's component belongs to."""
    return F.pmod(F.xxhash64("cc"), F.lit(groups)).alias("g")


def _groups(df: DataFrame, arcs: DataFrame) -> int:
    """The number of groups to walk the arcs in; 0 if a group would be too large for a task."""
    n = arcs.count()
    if n <= LOCAL_ARCS:
        return GROUPS
    groups = GROUPS * -(-n // LOCAL_ARCS)
    starts = arcs.groupBy("src").agg(F.count("*").alias("n"))
    sizes = df.select(F.col("node").alias("src"), _group(groups)).join(starts, "src", "left").groupBy("g").agg(F.sum(1 + F.coalesce("n", F.lit(0))).alias("n"))
    return groups if sizes.agg(F.max("n")).first()[0] <= LOCAL_ARCS // 2 else 0


def _in_tasks(df: DataFrame, arcs: DataFrame, tie: str, walk, groups: int) -> DataFrame:
    """node, rep: ``walk`` over the arcs in tasks that hold whole components, nodes by rank."""
    ranked = df.select("node", "cnt", F.col(tie).alias("tie"), "cc", _group(groups))
    ends = ranked.select(F.col("node").alias("src"), "g").join(arcs.select("src", "dst"), "src")
    kind = ranked.schema["tie"].dataType
    told = ranked.select("g", "node", "cnt", "tie", F.col("cc").alias("other")).unionByName(ends.select("g", F.col("src").alias("node"), F.lit(0).cast("long").alias("cnt"), F.lit(None).cast(kind).alias("tie"), F.col("dst").alias("other")))
    return told.groupBy("g").applyInArrow(_group_of(walk), "node bigint, rep bigint")


def _group_of(walk):
    def run(table: pa.Table) -> pa.Table:
        node, cnt, other = (table.column(c).to_numpy() for c in ("node", "cnt", "other"))
        is_node = cnt > 0
        names, cc, tie = node[is_node], other[is_node], np.array(table.column("tie").filter(pa.array(is_node)).to_pylist())
        # by component, then rank: a smaller place in this order is a better node
        names = names[np.lexsort((names, tie, -cnt[is_node], cc))]
        at = np.argsort(names)
        find = lambda x: at[np.searchsorted(names, x, sorter=at)]
        best = walk(len(names), find(node[~is_node]), find(other[~is_node]))
        return pa.table({"node": names, "rep": names[best]})

    return run


def _reach(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The best node that reaches each one, by vectorised rounds."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, dst, label[src])
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def _take(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """By rank, a node that is not taken takes those its arcs lead to."""
    order = np.lexsort((dst, src))
    dst, cut = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    taker = [-1] * n
    for i in range(n):
        if taker[i] < 0:
            taker[i] = i
            for j in dst[cut[i] : cut[i + 1]]:
                if taker[j] < 0:
                    taker[j] = i
    return np.array(taker, np.int64)


def trace(assignment: DataFrame, nodes: DataFrame, edges: DataFrame, ratio: float = 2.0) -> DataFrame:
    """src, dst, approved: an edge is approved if it may be walked and both ends share the molecule."""
    arcs = directed(nodes, edges, ratio).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct().withColumn("walked", F.lit(True))
    reps = assignment.select("node", "rep")
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).join(arcs, ["src", "dst"], "left")
    e = e.join(reps.withColumnsRenamed({"node": "src", "rep": "rep_src"}), "src").join(reps.withColumnsRenamed({"node": "dst", "rep": "rep_dst"}), "dst")
    return e.select("src", "dst", "rep_src", "rep_dst", (F.coalesce("walked", F.lit(False)) & (F.col("rep_src") == F.col("rep_dst"))).alias("approved"))


def greedy(nodes: DataFrame, edges: DataFrame, keys: list[str], may_take: Column | None = None, tie: str = "node") -> DataFrame:
    """By rank, a node not yet taken represents itself and takes its untaken neighbours.

    ``may_take`` limits it to neighbours, over cnt_src (taker) and cnt_dst. Arcs are
    walked in tasks that hold whole components. Where one is too large, a node is a
    representative if no better-ranked node that may take it is one; each round decides
    the nodes whose takers are decided.
    """
    df, all_arcs = with_components(nodes, edges), _arcs(nodes, edges)
    if groups := _groups(df, all_arcs):
        first = F.col("cnt_src") > F.col("cnt_dst")
        if tie == "node":
            better = first | (F.col("cnt_src") == F.col("cnt_dst")) & (F.col("src") < F.col("dst"))
        else:
            ties = lambda side: nodes.select(F.col("node").alias(side), F.col(tie).alias(f"tie_{side}"))
            all_arcs = all_arcs.join(ties("src"), "src").join(ties("dst"), "dst")
            better = first | (F.col("cnt_src") == F.col("cnt_dst")) & (F.struct("tie_src", "src") < F.struct("tie_dst", "dst"))
        arcs = all_arcs.where(better if may_take is None else better & may_take)
        return _columns(df.join(_in_tasks(df, arcs, tie, _take, groups), "node"), keys)
    df = settle(df)
    rank = lambda side: F.struct((-F.col("cnt")).alias("c"), F.col(tie).alias("t"), F.col("node").alias("n")).alias(f"rank_{side}")
    ends = lambda side: df.select(F.col("node").alias(side), F.col("cnt").alias(f"cnt_{side}"), rank(side))
    arcs = both_ways(edges).join(ends("src"), "src").join(ends("dst"), "dst").where("rank_src < rank_dst")
    arcs = settle((arcs.where(may_take) if may_take is not None else arcs).select("src", "dst", "rank_src"))
    state = settle(df.select("node", F.lit(None).cast("boolean").alias("is_rep")))
    while True:
        told = arcs.join(state.select(F.col("node").alias("src"), "is_rep"), "src").groupBy("dst").agg(F.max(F.coalesce("is_rep", F.lit(False))).alias("taken"), F.min(F.col("is_rep").isNotNull()).alias("known"))
        state = state.join(told.withColumnRenamed("dst", "node"), "node", "left")
        decided = F.when(F.col("taken"), False).when(F.coalesce("known", F.lit(True)), True)
        state = settle(state.select("node", F.coalesce("is_rep", decided).alias("is_rep")))
        if state.where("is_rep is null").isEmpty():
            break
    taker = arcs.join(state.where("is_rep").select(F.col("node").alias("src")), "src").groupBy("dst").agg(F.min_by("src", "rank_src").alias("taker"))
    df = df.join(state, "node").join(taker.withColumnRenamed("dst", "node"), "node", "left")
    return _columns(df.withColumn("rep", F.when(F.col("is_rep"), F.col("node")).otherwise(F.col("taker"))), keys)


def greedy_directional(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``greedy`` that takes neighbours of at most half the count."""
    return greedy(nodes, edges, keys, F.col("cnt_dst") <= 0.5 * F.col("cnt_src"))


def greedy_singleton(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``greedy`` that takes neighbours of one read."""
    return greedy(nodes, edges, keys, F.col("cnt_dst") == 1)


def consensus(assignment: DataFrame) -> DataFrame:
    """rep, size, consensus: the base with most reads at each place of a component, ties by letter."""
    bases = assignment.select("rep", "cnt", F.posexplode(F.filter(F.split("umi", ""), lambda c: c != "")).alias("place", "base"))
    by_place = bases.groupBy("rep", "place", "base").agg(F.sum("cnt").alias("w")).groupBy("rep", "place").agg(F.min_by("base", F.struct(-F.col("w"), "base")).alias("base"))
    text = by_place.groupBy("rep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "base"))), lambda p: p["base"]), "").alias("consensus"))
    return assignment.groupBy("rep").agg(F.count("*").alias("size")).join(text, "rep")


METHODS = {
    "unique": unique,
    "cluster": cluster,
    "adjacency": adjacency,
    "directional": directional,
    "starsolo": lambda n, e, k: directional(n, e, k, tie="umi"),
    "gencore": lambda n, e, k: cluster(n, e, k, tie="umi"),
    "component_lexical": lambda n, e, k: cluster(n, e, k, tie="umi"),
    "greedy": greedy,
    "greedy_directional": greedy_directional,
    "greedy_singleton": greedy_singleton,
}
