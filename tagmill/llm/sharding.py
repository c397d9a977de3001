"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups are hashed into a fixed number of bins, whose byte sums are all that reaches
the driver; equal texts share a bin, hence a shard. The bins are the items of a k-way
Karmarkar-Karp run: the two partial partitions with the largest spread are combined,
the larger sums of one with the smaller sums of the other, until one is left.

Slots are numbered without a global sort: rows are counted by shard and hash cell, the
counts' prefix sums give each cell its first slot, and rows are ranked in their cell.

Defined cases: null text has no bytes (size 1) and groups with the empty text; rows
repeat as they are, ties in a cell go by id, then checksum; an empty table gives no
rows; other columns are ignored. A group larger than a shard's share makes the shard
that holds it larger, as groups stay whole.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 1 << 16
CELLS = 1 << 10


def karmarkar_karp(sizes: dict[int, int], k: int) -> dict[int, int]:
    """Shard of each item of ``sizes`` under k-way differencing; ties go by item."""
    heap: list[tuple[int, int, list[tuple[int, list]]]] = []
    for order, item in enumerate(sorted(sizes)):
        parts: list[tuple[int, list]] = [(sizes[item], [item])] + [(0, [])] * (k - 1)
        heap.append((-sizes[item], order, parts))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # largest sum of one with the smallest of the other; members nest, not copied
        joined = sorted(((x[0] + y[0], _join(x[1], y[1])) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        low = joined[-1][0]
        heapq.heappush(heap, (low - joined[0][0], order, [(s - low, m) for s, m in joined]))
        order += 1
    out: dict[int, int] = {}
    for shard, (_, members) in enumerate(heap[0][2] if heap else []):
        stack = [members]
        while stack:
            top = stack.pop()
            if len(top) == 1:
                out[top[0]] = shard
            else:
                stack.extend(top)
    return out


def _join(x: list, y: list) -> list:
    return [x, y] if x and y else x or y


def shard_by_bytes(df: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 8, bins: int = BINS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(body), F.lit(bins)).cast("int").alias("bin"),
    ).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    sums = {r["bin"]: r["bytes"] for r in rows.groupBy("bin").agg(F.sum("size").alias("bytes")).collect()}  # at most ``bins`` rows
    placed = karmarkar_karp(sums, shards)
    by_bin = F.broadcast(spark.createDataFrame([(b, s) for b, s in placed.items()] or [(-1, 0)], "bin int, shard int"))  # at most ``bins`` rows
    rows = rows.join(by_bin, "bin").drop("bin")
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # at most shards * cells rows
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(F.broadcast(first), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))
