"""Read selection, ordering and writers: what a deduplication run ends with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACE = ("chrom", "pos")


def unique_reads(reads: DataFrame, wanted: DataFrame, read_id: str = "id") -> DataFrame:
    """Reads whose id is in ``wanted``, each id once (the first row by place)."""
    found = reads.join(wanted.select(read_id), read_id, "left_semi")
    columns = [c for c in found.columns if c != read_id]
    first = found.groupBy(read_id).agg(F.min(F.struct(*columns)).alias("row_"))
    return first.select(*(F.col(read_id) if c == read_id else F.col(f"row_.{c}").alias(c) for c in found.columns))


def coordinate_sorted(reads: DataFrame, tie: str = "id", partitions: int | None = None) -> DataFrame:
    """Reads in order of chromosome and place (unmapped last), range-partitioned, so files are sorted and do not overlap."""
    order = [F.col("chrom").asc_nulls_last(), F.col("pos").asc_nulls_last(), F.col(tie)]
    ranged = reads.repartitionByRange(partitions, *order) if partitions else reads.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def with_ordinal(reads: DataFrame, tie: str = "id") -> DataFrame:
    """``ordinal``: place of each read in coordinate order, from 0, by counts of the places before.

    Reads are ranked in their own place only; the running sums go over places.
    """
    places = reads.groupBy(*PLACE).agg(F.count("*").alias("n_"))
    per = places.groupBy("chrom").agg(F.sum("n_").alias("all_"))  # a row a chromosome
    earlier = per.select(F.col("chrom").alias("c_"), (F.sum("all_").over(W.orderBy(F.col("chrom").asc_nulls_last())) - F.col("all_")).alias("earlier_"))
    before = F.sum("n_").over(W.partitionBy("chrom").orderBy(F.col("pos").asc_nulls_last())) - F.col("n_")
    places = places.withColumn("before_", before).join(earlier, F.col("chrom").eqNullSafe(F.col("c_")))
    places = places.select(F.col("chrom").alias("c_"), F.col("pos").alias("p_"), (F.col("before_") + F.col("earlier_")).alias("first_"))
    ranked = reads.withColumn("rank_", F.row_number().over(W.partitionBy(*PLACE).orderBy(tie)))
    joined = ranked.join(places, F.col("chrom").eqNullSafe(F.col("c_")) & F.col("pos").eqNullSafe(F.col("p_")))
    return joined.select(*reads.columns, (F.col("first_") + F.col("rank_") - 1).alias("ordinal"))


def with_tags(reads: DataFrame, tags: DataFrame, name: str = "qname") -> DataFrame:
    """Tag columns of a table by read name; a name that is not in it has null tags. Of several rows of a name the least counts."""
    columns = [c for c in tags.columns if c != name]
    once = tags.groupBy(name).agg(F.min(F.struct(*columns)).alias("tags_")).select(name, *(F.col(f"tags_.{c}").alias(c) for c in columns))
    return reads.drop(*columns).join(once, name, "left")


def representatives(reads: DataFrame, keys: list[str], *, best: Column | None = None, mode: str = "filter", read_id: str = "id") -> DataFrame:
    """One read a key: the first by id, or the one of the largest ``best``.

    ``filter`` keeps those reads only; ``mark`` keeps all, with PD 0 for them and 1 for the others
    (reads without a full key are 1). A key's reads are reduced before they are dealt, none is ranked.
    """
    if mode not in ("filter", "mark"):
        raise ValueError(f"no mode {mode}")
    full = reads.where(" and ".join(f"`{k}` is not null" for k in keys))
    order = F.struct(-best, F.col(read_id)) if best is not None else F.struct(F.col(read_id))
    chosen = full.groupBy(*keys).agg(F.min_by(read_id, order).alias(read_id)).select(read_id)
    if mode == "filter":
        return reads.join(chosen, read_id, "left_semi")
    return reads.join(chosen.withColumn("kept_", F.lit(0)), read_id, "left").withColumn("PD", F.coalesce("kept_", F.lit(1))).drop("kept_")


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, compression: str = "none", mode: str = "errorifexists") -> None:
    """A delimited table: plain, gzip or bzip2 part files; nulls are empty."""
    df.write.mode(mode).csv(path, sep=sep, header=header, compression=compression, nullValue="", emptyValue="")


def write_representatives(assignment: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """JSON lines: the keys, a representative and the nodes it stands for."""
    representative_map(assignment, keys).write.mode(mode).json(path)


def representative_map(assignment: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rep and its nodes in order."""
    return assignment.groupBy(*keys, "rep").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
