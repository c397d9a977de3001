"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each dimension of a block of vectors is a sorted list; a query reads it in rank order
from the end where its product is largest, all lists to the same depth. What has been
read of a vector gives its partial score. What has not adds at most the reading fronts of
the lists that haven't shown it, and is in size at most the product of the norms of the
unread parts of query and vector (squared norms are read with the block and shrink with
every value); that gives the upper and the lower bound.

Reading stops as soon as the vectors whose upper bound reaches the k-th lower bound (or
the k-th score found so far, which carries over from block to block) are few: all others
can no longer qualify, and these few are resolved to final integer scores. At the end of
the lists the partial scores are final. Bounds are taken at the depths of STEPS, from a
little before the depth where the block before stopped. How far lists are read depends
on the data: evenly spread directions, as in the supplied table, need about three
quarters of them; ``Reads`` counts it. All lists being read to one depth, what is read
and what is hidden there are one matrix for all queries, and partial scores and bounds are
products with it.

Queries go in blocks of a fixed number, broadcast in turn against all vectors; a
partition returns at most k rows a query, and a window keeps the k best. With more than
one block each block's result is written before the next is fetched, so the driver holds
one block at a time.

Products are exact: components are integers, sums stay below 2**53 (checked). Bounds are
in single precision with a margin for its rounding.

Defined cases: vectors that are null or hold null or non-finite components take no part;
neither do vectors of another dimension than the query's; null ids are no queries and
no candidates; of repeated query ids the smallest vector is the query; rows with the
query's own id are never its candidates; repeated candidate rows each count; ties go to
the smaller id; fewer candidates than k give all; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.llm.common import one_thread, shared_folder

QUERY_BLOCK = 4096
VECTOR_BLOCK = 2048
BATCH = 256
#: Depths at which bounds are taken, as parts of the lists.
STEPS = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 11 / 16, 3 / 4, 13 / 16, 7 / 8, 1.0)
#: Depths whose state a block keeps.
STATES = 4
FOUND = "query_id long, vec_id long, score long"


def quantized(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and q: floor(scale * x) of each component; rows with unusable vectors go."""
    x = F.transform(vector, lambda v: v.cast("double"))
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(usable).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("q"))


class Lists:
    """Sorted lists of a block: values by rank, and the rank of each vector in each list."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.size = vectors, vectors.shape[1]
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, 0).astype(np.float32)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(vectors))[:, None], 0)
        self.values = np.tile(vectors.astype(np.float32), 2)
        self.square = self.values * self.values
        self.longest = self.square[:, : self.size].sum(axis=1).max()
        self.states: dict[int, tuple] = {}

    def state(self, depth: int) -> tuple:
        """At a depth, for both ends of the lists side by side: which lists have not shown a vector, the values read, the squares of those not read.

        The same for all queries, so the last few are kept.
        """
        if depth not in self.states:
            if len(self.states) >= STATES:
                self.states.pop(next(iter(self.states)))
            hidden = np.hstack([self.rank < len(self.rank) - depth, self.rank >= depth]).astype(np.float32)
            self.states[depth] = hidden, self.values * (1 - hidden), self.square * hidden
        return self.states[depth]


class Reads:
    """How much of the lists was read, of how much; and where to begin to take bounds."""

    def __init__(self):
        self.read = self.all = self.resolved = 0
        self.first = 0


def search_block(lists: Lists, queries: np.ndarray, floor: np.ndarray, k: int, own: np.ndarray, reads: Reads | None = None) -> list[np.ndarray]:
    """For each query the places in the block that may be among its k best; ``floor`` has scores to reach.

    ``own`` (queries x vectors) marks a query's own rows, which take no part in the bounds.
    """
    reads = reads or Reads()
    n, size = lists.vectors.shape
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
    live, floor, own = np.arange(len(queries)), floor.astype(np.float32), own.T
    q = queries.T.astype(np.float32)  # a row a list
    q = np.vstack([np.maximum(q, 0), np.minimum(q, 0)])  # the part that reads from the upper end, and that from the lower
    margin = (size + 16) * 2.4e-7 * np.sqrt((q * q).sum(axis=0) * lists.longest)
    at = stopped = 0
    for step, part in enumerate(STEPS):
        depth = n if part == 1 else max(1, int(n * part))
        reads.read += (depth - at) * size * len(live)
        at, stopped = depth, step
        if step < reads.first and part < 1:
            continue
        hidden, values, square = lists.state(depth)
        score = values @ q  # partial scores, vectors x queries
        lower, upper = score - margin, score + margin
        if part < 1:
            rest = np.sqrt((hidden @ (q * q)) * (square @ (q != 0).astype(np.float32)))
            front = hidden @ (q * np.concatenate([lists.sorted[n - depth], lists.sorted[depth - 1]])[:, None])
            lower -= rest
            upper += np.minimum(rest, front)
        if own.any():
            lower[own] = upper[own] = -np.inf
        if n > k:
            # a k-th lower bound over the floor needs k of them there
            raised = np.flatnonzero(np.count_nonzero(lower > floor, axis=0) >= k)
            floor[raised] = np.partition(np.ascontiguousarray(lower.T[raised]), n - k, axis=1)[:, n - k]
        reach = upper >= floor
        few = (np.count_nonzero(reach, axis=0) <= max(4 * k, n // 8)) | (part == 1)
        for i in np.flatnonzero(few):
            out[live[i]] = np.flatnonzero(reach[:, i])
            reads.resolved += len(out[live[i]])
        if few.all():
            break
        if few.mean() > 0.25:  # carry on with the others only
            live, floor, margin, own, q = live[~few], floor[~few], margin[~few], own[:, ~few], q[:, ~few]
    reads.first = max(stopped - 1, 0)
    reads.all += n * size * len(queries)
    return out


def top_k(df: DataFrame, queries: DataFrame, *, k: int = 20, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; ``df`` and ``queries`` have vec_id and q (doubles of integer value)."""
    spark = df.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = -(-asked.count() // query_block) or 1
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    folder = f"{shared_folder(spark)}/top-{uuid.uuid4().hex}" if blocks > 1 else None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        by_size: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r["vec_id"]):
            by_size.setdefault(len(r["q"]), []).append(r)
        state = {d: (np.array([r["vec_id"] for r in g], np.int64), np.array([r["q"] for r in g], np.float64).reshape(len(g), d)) for d, g in by_size.items()}
        shared = spark.sparkContext.broadcast(state)
        found = df.select("vec_id", "q").mapInArrow(_searcher(shared, k, vector_block), FOUND)
        out = found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if folder is None:
            return out
        out.write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.parquet(folder)


def _searcher(shared, k: int, vector_block: int):
    def search(batches):
        with one_thread():
            yield from found(batches)

    def found(batches):
        best = {d: ([np.zeros(0, np.int64)] * len(ids), [np.zeros(0, np.int64)] * len(ids)) for d, (ids, _) in shared.value.items()}
        held: dict[int, list] = {}
        reads = Reads()

        def take(size: int) -> None:
            held_ids, vectors = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
            pieces = -(-len(held_ids) // vector_block)  # an Arrow batch may hold several blocks
            for block_ids, block in zip(np.array_split(held_ids, pieces), np.array_split(vectors, pieces), strict=True):
                take_block(size, block_ids, block)

        def take_block(size: int, own: np.ndarray, vectors: np.ndarray) -> None:
            ids, queries = shared.value[size]
            if len(queries) and size and np.abs(queries).max() * np.abs(vectors).max() * size >= 2**53:
                raise ValueError("scores don't fit exact arithmetic")
            scores, names = best[size]
            lists = Lists(vectors) if size else None
            for at in range(0, len(ids), BATCH):
                part = slice(at, at + BATCH)
                floor = np.array([s[-1] if len(s) >= k else -np.inf for s in scores[part]])
                places = search_block(lists, queries[part], floor, k, ids[part][:, None] == own, reads) if size else [np.arange(len(own))] * len(queries[part])
                for i, at_places in enumerate(places, at):
                    at_places = at_places[own[at_places] != ids[i]]
                    s = np.concatenate([scores[i], (vectors[at_places] @ queries[i]).astype(np.int64)])
                    v = np.concatenate([names[i], own[at_places]])
                    keep = np.lexsort((v, -s))[:k]
                    scores[i], names[i] = s[keep], v[keep]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            q = batch.column(1)
            flat, sizes = q.flatten().to_numpy(zero_copy_only=False), np.diff(q.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes).tolist():
                if size not in best:
                    continue
                rows = np.flatnonzero(sizes == size)
                held.setdefault(size, []).append((ids[rows], flat[starts[rows][:, None] + np.arange(size)]))
                if sum(len(x) for x, _ in held[size]) >= vector_block:
                    take(size)
        for size in list(held):
            take(size)
        for size, (ids, _) in shared.value.items():
            scores, names = best[size]
            counts = [len(s) for s in scores]
            if sum(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(names)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    return search
