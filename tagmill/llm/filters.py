"""Dropping documents by id without moving the others' texts.

A bitmap of hashed ids, sized by their number, tells in one pass over the documents the
rows that surely stay; only the others are joined with the ids to drop.

Other columns may have any names: what is added for the work is named apart from them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.llm.common import lean, text_batches

#: Bits of a bitmap: sixteen a value (one of sixteen others passes), in these bounds (2 and 32 MB at most to the tasks).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of ``frames`` has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def bitmap(df: DataFrame, column: str, bits: int | None = None) -> np.ndarray:
    """Bits of the hashed values of a column: tells values that are surely absent.

    More values than MOST_BITS is meant for let more absent ones pass, which costs but harms nothing.
    """
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * df.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = df.select((at / 32768).cast("int").alias("b"), (at % 32768).cast("int").alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[r["b"]] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out.ravel()


def split(df: DataFrame, column: str, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be among ``values`` (one column), and rows whose surely isn't."""
    spark = df.sparkSession
    text_batches(spark)
    bits = bitmap(values, values.columns[0])
    shared = spark.sparkContext.broadcast(bits)
    at_name = free_name("at_", df)
    placed = df.withColumn(at_name, F.pmod(F.xxhash64(column), F.lit(8 * len(bits))).cast("int"))

    def pick(wanted):
        def run(batches):
            for batch in batches:
                at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                has = (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                yield batch.filter(pa.array(has == wanted))

        return placed.mapInArrow(lean(run), placed.schema).drop(at_name)

    return pick(True), pick(False)


def row_key(docs: DataFrame, key: str = "doc_id"):
    """Id and hash of all columns: equal for rows alike only, never null."""
    return F.concat_ws("-", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.xxhash64(*docs.columns).cast("string"))


def without_rows(docs: DataFrame, gone: DataFrame, *, once: bool = False) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in the first column of ``gone``; with ``once`` also one of rows alike only."""
    name = free_name("row_", docs)
    return without(docs.withColumn(name, row_key(docs)), gone.select(F.col(gone.columns[0]).alias(name)), key=name, once=once).drop(name)


def without(docs: DataFrame, gone: DataFrame, *, key: str = "doc_id", once: bool = False) -> DataFrame:
    """``docs`` without the ids of ``gone``; with ``once`` also one row of each id only (null ids all stay)."""
    k, drop, rank = (free_name(x, docs) for x in ("k_", "gone_", "rank_"))
    special = gone.select(F.col(key).alias(k)).where(F.col(k).isNotNull()).distinct().withColumn(drop, F.lit(True))
    if once:
        repeated = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(k)).agg(F.count("*").alias(rank)).where(F.col(rank) > 1).select(k, F.lit(False).alias(drop))
        special = special.unionByName(repeated).groupBy(k).agg(F.max(drop).alias(drop))
    moved, rest = split(docs, key, special.select(k))
    moved = moved.join(special, F.col(key) == F.col(k), "left").where(~F.coalesce(F.col(drop), F.lit(False)))
    if once:
        order = W.partitionBy(k).orderBy(F.xxhash64(*docs.columns))
        twice = moved.where(F.col(k).isNotNull()).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
        moved = twice.select(*docs.columns).unionByName(moved.where(F.col(k).isNull()).select(*docs.columns))
    return moved.select(*docs.columns).unionByName(rest)
