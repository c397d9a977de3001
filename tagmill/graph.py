"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir; a local session may do without one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tagmill-checkpoint-"))
    return bounded(df.checkpoint(eager=True))


def bounded(settled: DataFrame) -> DataFrame:
    """The same rows without a size estimate that has outgrown a long.

    A checkpoint keeps the estimate of the plan that made it, and a join's is the product of
    its sides': over rounds that join what they settled, its digits multiply until they fill
    the driver's memory. Spark's default for unknown sizes takes its place.
    """
    spark, plan = settled.sparkSession, settled._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() < 1 << 63:
        return settled
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), settled._jdf.schema(), False), spark)


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges of one batch, by vectorised hooking."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return nodes, nodes[root]


def _contract(batches):
    """Edges of a partition as stars to the smallest node of each local component."""
    for batch in batches:
        src, dst = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(src):
            node, low = forest(src, dst)
            keep = node != low
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(low[keep])], ["src", "dst"])


#: Contracted edges up to this number (16 bytes each) are finished in one task.
ONE_TASK_EDGES = 1 << 21


def _finish(batches):
    """(node, component) of all edges that come to this task."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if parts:
        node, low = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(low)], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (src, dst: long).

    Edges are contracted to local stars first. What is left is finished in one task if its
    checked number is small, else by rounds.

    Each round hooks every node to its smallest neighbour, follows the hooks once and
    renames the edges' ends; inner edges vanish. Nodes without an edge to another node
    don't appear. Hubs are summed before they are dealt out and their joins can be split.
    """
    edges = edges.select("src", "dst").where("src <> dst").mapInArrow(_contract, "src long, dst long").distinct()
    edges = settle(edges)
    if edges.count() <= ONE_TASK_EDGES:
        return settle(edges.coalesce(1).mapInArrow(_finish, "node long, component long"))
    return _by_rounds(edges)


def _by_rounds(edges: DataFrame) -> DataFrame:
    names = None  # node -> current name
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("up"))
        next_up = hook.select(F.col("src").alias("up"), F.col("up").alias("top"))
        hook = settle(hook.join(next_up, "up").select("src", "top"))  # every hook's target is a node
        renamed = edges.join(hook, "src").select("dst", F.col("top").alias("a")).join(hook.withColumnRenamed("src", "dst"), "dst").select(F.col("a").alias("src"), F.col("top").alias("dst"))
        edges = settle(renamed.where("src <> dst").select(F.least("src", "dst").alias("dst"), F.greatest("src", "dst").alias("src")).distinct())
        if names is None:
            names = hook.select(F.col("src").alias("node"), F.col("top").alias("component"))
        else:
            step = hook.withColumnRenamed("src", "component")
            names = settle(names.join(step, "component", "left").select("node", F.coalesce("top", "component").alias("component")))
    if names is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return names
