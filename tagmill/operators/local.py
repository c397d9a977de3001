"""Kernel methods run per component or group, with Arrow-batched pandas frames.

A group's frame is one component (or one barcode group for the methods that need it),
so a large locus still spreads over tasks by its components.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.operators import kernels as K
from tagmill.operators.graphs import with_components


def _with_neighbours(nodes: DataFrame, edges: DataFrame, keys: list[str], more: Sequence[str] = ()) -> DataFrame:
    near = edges.groupBy("src").agg(F.collect_list("dst").alias("near"))
    return with_components(nodes, edges).join(near.withColumnRenamed("src", "node"), "node", "left").select(*keys, "cc", "node", "umi", "cnt", *more, F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["node bigint", "umi string", "cnt bigint", "cc bigint", "rep bigint"])


def _rank(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["cnt", "node"], ascending=[False, True], ignore_index=True)


def _pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours by place in the frame."""
    near = frame["near"]
    dst = np.concatenate([np.asarray(x, np.int64) for x in near]) if len(near) else np.zeros(0, np.int64)
    src = np.repeat(np.arange(len(frame)), [len(x) for x in near])
    names = frame["node"].to_numpy()
    order = np.argsort(names)
    at = order[np.minimum(np.searchsorted(names, dst, sorter=order), max(len(names) - 1, 0))] if len(names) else dst
    known = names[at] == dst if len(dst) else np.zeros(0, bool)
    return src[known], at[known]


def _apply(df: DataFrame, by: list[str], keys: list[str], labels) -> DataFrame:
    """Assignment from ``labels(frame)``: a representative's place for each row, frame ranked."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _rank(frame)
        frame["rep"] = frame["node"].to_numpy()[np.asarray(labels(frame), int)]
        return frame[[*keys, "node", "umi", "cnt", "cc", "rep"]]

    return df.groupBy(*by).applyInPandas(run, _schema(df, keys))


def _first_of(label: np.ndarray) -> np.ndarray:
    """Place of the first (best-ranked) member of each row's label; -1 labels stand alone."""
    label = np.where(label < 0, len(label) + np.arange(len(label)), label)
    _, first, at = np.unique(label, return_index=True, return_inverse=True)
    return first[at]


def _mcl_labels(frame: pd.DataFrame, inflation: float, expansion: int, iterations: int) -> np.ndarray:
    label = np.full(len(frame), -1)
    for k, own in enumerate(K.markov_clusters(len(frame), *_pairs(frame), inflation, expansion, iterations)):
        label[own] = k
    return _first_of(label)


def mcl(nodes: DataFrame, edges: DataFrame, keys: list[str], inflation: float = 1.6, expansion: int = 2, iterations: int = 100, whole_group: bool = False) -> DataFrame:
    """Markov clusters of each component (or of each whole group's graph)."""
    df = _with_neighbours(nodes, edges, keys)
    return _apply(df, keys if whole_group else ["cc"], keys, lambda f: _mcl_labels(f, inflation, expansion, iterations))


def _merged(frame: pd.DataFrame, link, inflation: float, expansion: int, iterations: int) -> np.ndarray:
    rep = _mcl_labels(frame, inflation, expansion, iterations)
    groups, _, _ = K.merge_representatives(sorted(set(rep.tolist())), lambda a, b: link(frame, a, b))
    to = {r: g[0] for g in groups for r in g}
    return np.array([to[r] for r in rep])


def mcl_val(nodes: DataFrame, edges: DataFrame, keys: list[str], t: float = 2.0, strict: bool = True, **options) -> DataFrame:
    """Markov clusters whose representatives' counts are one more than ``t`` times apart are merged."""
    above = lambda a, b: a > t * b - 1 if strict else a >= t * b - 1
    link = lambda f, a, b: above(f["cnt"][a], f["cnt"][b]) or above(f["cnt"][b], f["cnt"][a])
    o = {"inflation": 1.6, "expansion": 2, "iterations": 100} | options
    return _apply(_with_neighbours(nodes, edges, keys), ["cc"], keys, lambda f: _merged(f, link, **o))


def mcl_ed(nodes: DataFrame, edges: DataFrame, keys: list[str], t: int = 1, **options) -> DataFrame:
    """Markov clusters whose representatives are at most ``t`` apart are merged."""
    link = lambda f, a, b: sum(x != y for x, y in zip(f["umi"][a], f["umi"][b], strict=False)) <= t
    o = {"inflation": 1.6, "expansion": 2, "iterations": 100} | options
    return _apply(_with_neighbours(nodes, edges, keys), ["cc"], keys, lambda f: _merged(f, link, **o))


def dbscan_components(nodes: DataFrame, keys: list[str], eps: float = 1.5) -> DataFrame:
    """DBSCAN with one sample as core: components at Hamming distance up to eps squared / 2, all relational."""
    from tagmill.operators.dedup import cluster
    from tagmill.operators.graphs import build_edges

    return cluster(nodes, build_edges(nodes, keys, int(eps * eps / 2), "le"), keys)


_POINTS = {
    "dbscan": lambda x, o: K.dbscan(x, o.get("eps", 1.5), o.get("min_samples", 1)),
    "birch": lambda x, o: K.birch(x, o.get("threshold", 1.8)),
    "affinity_propagation": lambda x, o: K.affinity_propagation(x, o.get("preference")),
    "hdbscan": lambda x, o: K.hdbscan(x, o.get("min_samples", 3), o.get("min_cluster", 5)),
}


def point_clusters(nodes: DataFrame, edges: DataFrame, keys: list[str], method: str, whole_group: bool = False, **options) -> DataFrame:
    """Clusters of one-hot barcodes in each component (or group); noise stands alone."""
    labels = lambda f: _first_of(np.asarray(_POINTS[method](K.one_hot(f["umi"].tolist()), options)))
    return _apply(_with_neighbours(nodes, edges, keys), keys if whole_group else ["cc"], keys, labels)


def set_cover(nodes: DataFrame, keys: list[str], k: int = 3, mode: str = "vote") -> DataFrame:
    """Homopolymer barcodes of a group clustered by greedy cover with monomers."""
    df = nodes.withColumn("cc", F.col("node")).withColumn("near", F.array().cast("array<bigint>"))

    def labels(frame: pd.DataFrame) -> np.ndarray:
        at = {u: i for i, u in enumerate(frame["umi"])}
        label = np.full(len(frame), -1)
        for c, own in enumerate(K.set_cover(frame["umi"].tolist(), k, mode)):
            label[[at[u] for u in own]] = c
        return _first_of(label)

    return _apply(df, keys, keys, labels)


def _index_edges(frame: pd.DataFrame) -> list[tuple[int, int]]:
    at = {n: i for i, n in enumerate(frame["node"])}
    return sorted({(min(i, at[n]), max(i, at[n])) for i, near in enumerate(frame["near"]) for n in near if n in at})


def classic_merge(nodes: DataFrame, edges: DataFrame, keys: list[str], multiplier: float = 1.0) -> DataFrame:
    labels = lambda f: K.merge_classic(list(zip(f["umi"], f["cnt"], strict=True)), _index_edges(f), multiplier)
    return _apply(_with_neighbours(nodes, edges, keys), ["cc"], keys, labels)


def bayes_merge(nodes: DataFrame, edges: DataFrame, keys: list[str], bins: int = 10, threshold: float = 0.9) -> DataFrame:
    """Naive Bayes on quality, count ratio and count of the base, trained over all pairs, then merges per group.

    Pairs go from the rarer barcode (base) to the other. A training pair is an error if the
    ratio of counts is at most 0.2, or if the base has at most 2 reads and the target 4 or
    more; pairs of ratio 0.5 or more with 3 or more reads each are none. The model is a few
    numbers a bin: quantile borders and smoothed bin counts from two aggregations. ``quality``
    of the nodes is a mean of their reads; 30 where there is none.

    The bar depends on the live barcodes of the group up to a number; a group with that
    many components always stays at its upper limit, so its components are merged apart.
    """
    from tagmill.functions.umi import digitize

    quality = F.coalesce(F.col("quality").cast("double"), F.lit(30.0)) if "quality" in nodes.columns else F.lit(30.0)
    nodes = nodes.withColumn("quality", quality)
    end = lambda name: nodes.select(F.col("node").alias(name), F.struct("cnt", "quality", "umi").alias(f"{name}_"))
    pairs = edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    pairs = pairs.select(F.least("src_", "dst_").alias("base"), F.greatest("src_", "dst_").alias("target"))
    pairs = pairs.select(F.col("base.quality").alias("quality"), (F.col("base.cnt") / F.greatest("target.cnt", F.lit(1))).alias("ratio"), F.col("base.cnt").cast("double").alias("low"), F.col("target.cnt").alias("high"))
    error = (F.col("ratio") <= 0.2) | (F.col("low") <= 2) & (F.col("high") >= 4)
    alike = (F.col("ratio") >= 0.5) & (F.col("low") >= 3) & (F.col("high") >= 3)
    pairs = pairs.select("quality", "ratio", "low", (error & ~alike).cast("int").alias("err"))
    parts = ("quality", "ratio", "low")
    at = F.array(*map(F.lit, np.linspace(0, 1, bins + 1)[1:-1].tolist()))
    row = pairs.agg(*(F.percentile(c, at).alias(c) for c in parts)).first()
    borders = {c: sorted(set(row[c] or [])) for c in parts}
    binned = pairs.select("err", *(digitize(F.col(c), borders[c]).alias(c) if borders[c] else F.lit(0).alias(c) for c in parts))
    seen = {tuple(r)[:-1]: r["count"] for r in binned.groupBy("err", *parts).count().collect()}  # at most 2 * bins cubed rows
    prior = np.array([sum(n for k, n in seen.items() if k[0] == err) for err in (0, 1)], float)
    prior = prior / prior.sum() if prior.all() else np.array([0.5, 0.5])
    tables = []
    for i, c in enumerate(parts, 1):
        table = np.ones((2, len(borders[c]) + 1))
        for k, n in seen.items():
            table[k[0], k[i]] += n
        tables.append((np.array(borders[c]), np.log(table / table.sum(axis=1, keepdims=True))))
    prior = np.log(prior)

    def posterior(*values: np.ndarray) -> np.ndarray:
        no, yes = prior[0], prior[1]
        for (border, table), x in zip(tables, values, strict=True):
            place = np.digitize(x, border)
            no, yes = no + table[0, place], yes + table[1, place]
        most = np.maximum(no, yes)
        no, yes = np.exp(no - most), np.exp(yes - most)
        return yes / (no + yes)

    capped = 0
    while threshold + 0.05 * np.log1p(capped) < 0.99:
        capped += 1
    df = _with_neighbours(nodes, edges, keys, ["quality"])
    few = df.groupBy(*keys).agg(F.count_if(F.col("node") == F.col("cc")).alias("n_")).where(F.col("n_") < capped)
    few = few.select(*(F.col(k).alias(f"{k}_") for k in keys), F.lit(True).alias("whole"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    df = df.join(few, same, "left").withColumn("part", F.when(F.col("whole"), F.lit(None)).otherwise(F.col("cc")))

    def labels(frame: pd.DataFrame) -> list[int]:
        others = 0 if frame["part"].isna().all() else np.inf
        return K.merge_bayes(frame["umi"].tolist(), frame["cnt"].to_numpy(), frame["quality"].to_numpy(), _index_edges(frame), posterior, threshold, others=others)

    return _apply(df, [*keys, "part"], keys, labels)
