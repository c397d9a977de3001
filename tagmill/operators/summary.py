"""Group summaries, duplicate marks and read-level results of an assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.functions import umi as U
from tagmill.operators.graphs import average_distance, build_nodes


def summarize(assignment: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dedup_cnt, ave_ed over representatives, and what deduplication removes."""
    is_rep = F.col("node") == F.col("rep")
    counts = assignment.groupBy(*keys).agg(
        F.sum(is_rep.cast("long")).alias("dedup_cnt"),
        F.count("*").alias("num_uniq_umis"),
        F.sum((~is_rep).cast("long")).alias("num_diff_dedup_uniq_umis"),
        F.sum(F.when(~is_rep, F.col("cnt")).otherwise(0)).alias("num_diff_dedup_reads"),
    )
    distances = average_distance(assignment.where(is_rep).select(*keys, "umi"), keys)
    return counts.join(distances, keys).select(*keys, "dedup_cnt", "ave_ed", "num_uniq_umis", "num_diff_dedup_uniq_umis", "num_diff_dedup_reads")


def distance_bins(summary: DataFrame) -> DataFrame:
    """ave_ed, count over groups."""
    return summary.groupBy("ave_ed").agg(F.count("*").alias("count"))


def filled_bins(bins: DataFrame, length: int) -> DataFrame:
    """Bins with zeros for the distances 0 to ``length`` that no group has."""
    every = bins.sparkSession.range(length + 1).select(F.col("id").cast("double").alias("ave_ed"))
    return every.join(bins, "ave_ed", "left").select("ave_ed", F.coalesce("count", F.lit(0)).alias("count"))


def weighted_distance(assignment: DataFrame, keys: list[str]) -> DataFrame:
    """keys, eds: mean distance between representatives, weighted by reads, rounded half to even.

    From weighted base counts by place: sum over pairs of w1 w2 = ((sum w)^2 - sum w^2) / 2.
    """
    reps = assignment.where("node = rep").select(*keys, "umi", "cnt")
    pairs = (F.pow(F.sum("cnt"), F.lit(2)) - F.sum(F.col("cnt") * F.col("cnt"))) / 2
    total = reps.groupBy(*keys).agg(pairs.alias("pairs"))
    places = reps.select(*keys, "cnt", F.posexplode(F.filter(F.split("umi", ""), lambda c: c != "")).alias("place", "base"))
    by_base = places.groupBy(*keys, "place", "base").agg(F.sum("cnt").alias("w"))
    by_place = by_base.groupBy(*keys, "place").agg(((F.pow(F.sum("w"), F.lit(2)) - F.sum(F.col("w") * F.col("w"))) / 2).alias("d"))
    return total.join(by_place.groupBy(*keys).agg(F.sum("d").alias("d")), keys).select(*keys, F.when(F.col("pairs") > 0, F.bround(F.col("d") / F.col("pairs"))).otherwise(-1.0).alias("eds"))


def mark(reads: DataFrame, assignment: DataFrame, keys: list[str], umi: str = "umi", read_id: str = "id") -> DataFrame:
    """Reads with UMI_mapped (the molecule's barcode) and PD (0: the read kept for its molecule, 1: duplicate)."""
    reps = assignment.where("node = rep").select(F.col("rep"), F.col("umi").alias("UMI_mapped"))
    named = assignment.select(*keys, F.col("umi").alias(umi), "rep").join(reps, "rep")
    return reads.join(named, [*keys, umi], "left").withColumn("PD", F.when(F.col(read_id) == F.col("rep"), 0).otherwise(1)).drop("rep")


def kept_reads(reads: DataFrame, assignment: DataFrame, read_id: str = "id") -> DataFrame:
    """The first read of each molecule's representative."""
    return reads.join(assignment.where("node = rep").select(F.col("node").alias(read_id)), read_id, "left_semi")


def removed_nodes(assignment: DataFrame) -> DataFrame:
    return assignment.where("node <> rep")


def spike_corrected(reads: DataFrame, keys: list[str], method, k: int, umi: str = "umi", read_id: str = "id") -> DataFrame:
    """Reads with ``corrected``: the representative of the barcode under distance up to ``k``."""
    from tagmill.operators.graphs import build_edges

    nodes = build_nodes(reads, keys, umi, read_id)
    assignment = method(nodes, build_edges(nodes, keys, k, "le"), keys)
    return mark(reads, assignment, keys, umi, read_id).withColumnRenamed("UMI_mapped", "corrected").drop("PD")


def all_pairs(nodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Theta join of a group's barcodes with zip-truncated distances: for small groups and checks."""
    a, b = nodes.select(*keys, F.col("node").alias("src"), F.col("umi").alias("u")), nodes.select(*keys, F.col("node").alias("dst"), F.col("umi").alias("v"))
    return a.join(b, keys).where("src < dst").withColumn("ed", U.hamming(F.col("u"), F.col("v"))).where(F.col("ed") == k).select(*keys, "src", "dst", "ed")
