"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources share the total size by weight; a source stops at ``most`` times its
size and the excess is shared again by weight. That fixpoint is min(most * size,
level * weight) for one level, found from prefix sums over sources by size / weight.

A source's words come as complete epochs over all of its documents, then a fractional
one: documents go by the exponential key -ln(u) / weight (u from a hash of the id and
the seed), and sizes are summed until the rest of the budget is used; the document at
the edge gives the words that are left. Keys are cut into cells, so no source, however
large, is sorted in one task: cell totals are summed per source, and only documents of
the cell that holds the edge are ranked.

Defined cases: null text has size 0 and is taken 0 times; null ids and repeated rows
are ordinary rows (equal keys go by size, then text hash); sources go by code point,
the null source last; a weight that is null, not finite or not positive counts as 1;
an empty table gives no rows; other columns are kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.llm.common import settle
from tagmill.llm.filters import free_name

#: Words are maximal runs of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
CELLS = 1 << 10
#: Sources up to this number have their budgets broadcast; above it Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, repeating, over sources by code point, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).cast("long"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): level fill under a cap of ``most`` sizes."""
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = sources.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("open_weight"),
        (most * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).alias("used"),
    )
    df = df.withColumn("level", (F.col("total") - F.col("used")).cast("double") / F.col("open_weight"))
    cap = most * F.col("source_size")
    # the level is the one of the first source that stays under its cap
    df = df.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    return df.select("source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))).alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1] that depends on ``key`` and ``seed`` only."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"/{seed}")).cast("binary")), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long") + 1).cast("double") / float(1 << 52)


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", quality: DataFrame | None = None, weights=cycle_weights, most: int = MOST, seed: int = 8, cells: int = CELLS) -> DataFrame:
    """doc_id, size, source_size, target, taken and text_hash of every row.

    ``quality`` has a sampling weight by doc_id, 1 where it has no row.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    worth = F.lit(1.0)
    if quality is not None:
        rows = rows.join(quality.select(F.col("doc_id").alias("q_"), F.col("quality").cast("double").alias("worth")).dropDuplicates(["q_"]), F.col("doc_id") == F.col("q_"), "left").drop("q_")
        worth = F.when((F.col("worth") > 0) & (F.col("worth") < float("inf")), F.col("worth")).otherwise(1.0)
    rows = rows.withColumn("es_key", -F.log(draw(F.col("doc_id"), seed)) / worth).drop("worth")
    # a cell holds a range of keys: 1 - exp(-key) is even for weight 1
    rows = settle(rows.withColumn("cell", F.least(F.floor((1 - F.exp(-F.col("es_key"))) * cells), F.lit(cells - 1)).cast("int")))
    by_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("size"))
    by_source = by_cell.groupBy("source").agg(F.sum("size").alias("source_size"))
    budget = targets(weights(by_source), most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budget = budget.withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    # the cell that holds the edge, from at most ``cells`` rows a source
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cell_sums = by_cell.withColumn("before", before).withColumnRenamed("source", "s").join(budget, F.col("s").eqNullSafe(F.col("source")))
    edge = cell_sums.where("before < rest").groupBy("s").agg(F.max("cell").alias("edge_cell"), F.max("before").alias("edge_before"))
    plan = budget.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", F.coalesce("edge_cell", F.lit(-1)).alias("edge_cell"), F.coalesce("edge_before", F.lit(0)).alias("edge_before"))
    plan = settle(plan)
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_edge = rows.where(F.col("cell") == F.col("edge_cell"))
    rank = W.partitionBy("source").orderBy("es_key", F.col("doc_id").asc_nulls_first(), "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    so_far = F.col("edge_before") + F.coalesce(F.sum("size").over(rank), F.lit(0))
    part = F.greatest(F.least(F.col("size"), F.col("rest") - so_far), F.lit(0))
    columns = ["doc_id", "size", "source_size", "target"]
    whole = F.col("epochs") * F.col("size")
    inner = rows.where(F.col("cell") != F.col("edge_cell")).select(*columns, (whole + F.when(F.col("cell") < F.col("edge_cell"), F.col("size")).otherwise(0)).alias("taken"), "text_hash")
    return inner.unionByName(at_edge.select(*columns, (whole + part).alias("taken"), "text_hash"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each document as often as its words are taken.

    Whole epochs repeat the row; of the document at a source's edge the row comes once
    more if at least half of its words are taken. Rows of the mix and of ``docs`` meet by
    (id, text hash); identical rows of one id share their copies.
    """
    taken = mix(docs, **options).where("taken > 0")
    k, h, n, copy = (free_name(x, docs) for x in ("k_", "h_", "copies_", "copy_"))
    copies = taken.groupBy(F.col("doc_id").alias(k), F.col("text_hash").alias(h)).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias(n)).where(F.col(n) > 0)
    name, text = options.get("key", "doc_id"), options.get("text", "text")
    joined = docs.join(copies, F.col(name).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)
