"""Barcode nodes and edges.

A node is a distinct barcode of a group and is named by its first read's id, which is
unique over all groups: no numbering by a window, and graph steps need no group keys.
Rank of a node: count descending, then first read (or barcode).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagmill.functions import umi as U
from tagmill.graph import components, settle


def build_nodes(reads: DataFrame, keys: list[str], umi: str = "umi", read_id: str = "id", quality: str | None = None) -> DataFrame:
    """keys, umi, cnt, node (and the mean ``quality`` if asked for): one hash aggregation with map-side counts."""
    mean = [F.avg(quality).alias("quality")] if quality else []
    return reads.where(F.col(umi).isNotNull()).groupBy(*keys, F.col(umi).alias("umi")).agg(F.count("*").alias("cnt"), F.min(read_id).alias("node"), *mean)


def numbered(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Add node_id: 0, 1, ... by first appearance in the group."""
    return nodes.withColumn("node_id", F.row_number().over(W.partitionBy(*keys).orderBy("node")) - 1)


def _masked(umi: Column, places: tuple[int, ...]) -> Column:
    for i in places:
        umi = F.overlay(umi, F.lit("*"), F.lit(i + 1))
    return umi


def build_edges(nodes: DataFrame, keys: list[str], k: int = 1, rule: str = "eq", length: int | None = None, counts: bool = False) -> DataFrame:
    """keys, src, dst, ed with src < dst: barcodes of one group and length at distance k (``le``: up to k).

    With ``counts`` also cnt_src and cnt_dst, so that methods need not look them up.

    Barcodes within distance k agree once the k places where they differ are masked, so an
    equi-join on (keys, mask) finds all pairs without comparing all. For k = 1 a pair
    meets in exactly one mask. ``length`` is the longest barcode, found by a scan if not given.
    """
    if k == 0:
        none = nodes.limit(0).select(*keys, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("ed"), F.lit(0).cast("long").alias("cnt_src"), F.lit(0).cast("long").alias("cnt_dst"))
        return none if counts else none.drop("cnt_src", "cnt_dst")
    length = length or nodes.agg(F.max(F.length("umi"))).first()[0] or 0
    masks = [m for m in combinations(range(length), min(k, length))] if length else []
    if not masks:
        return build_edges(nodes, keys, 0, counts=counts)
    array = F.array(*(F.when(F.length("umi") > m[-1], _masked(F.col("umi"), m)) for m in masks))
    # short barcodes have fewer masks; those no longer than k all meet under one
    array = F.when(F.length("umi") <= k, F.array(F.repeat(F.lit("*"), F.length("umi")))).otherwise(F.filter(array, lambda m: m.isNotNull()))
    more = ["cnt"] if counts else []
    side = nodes.select(*keys, "node", "umi", *more, F.explode(F.array_distinct(array)).alias("mask"))
    left = side.select(*keys, "mask", F.col("node").alias("src"), F.col("umi").alias("umi_src"), *(F.col(c).alias(f"{c}_src") for c in more))
    right = side.select(*keys, "mask", F.col("node").alias("dst"), F.col("umi").alias("umi_dst"), *(F.col(c).alias(f"{c}_dst") for c in more))
    pairs = left.join(right, [*keys, "mask"]).where("src < dst")
    both = [f"{c}_{end}" for c in more for end in ("src", "dst")]
    if k == 1:
        return pairs.select(*keys, "src", "dst", F.lit(1).alias("ed"), *both)
    ed = U.hamming(F.col("umi_src"), F.col("umi_dst"))
    pairs = pairs.withColumn("ed", ed).where(F.col("ed") == k if rule == "eq" else F.col("ed") <= k)
    return pairs.select(*keys, "src", "dst", "ed", *both).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def with_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add cc, the smallest node of the component."""
    named = components(edges.select("src", "dst"))
    return nodes.join(named, "node", "left").withColumn("cc", F.coalesce("component", "node")).drop("component")


def average_distance(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ave_ed: mean Hamming distance over all pairs, rounded up; -1 for one barcode.

    From base counts by place: a place adds the pairs of unequal bases, so no pair is formed.
    Barcodes of a group count to the shortest one's length.
    """
    # place 0 stands for the whole barcode, so it counts them all; a place beyond the shortest barcode counts fewer
    letters = F.concat(F.array(F.lit("")), F.filter(F.split("umi", ""), lambda c: c != ""))
    counts = nodes.select(*keys, F.posexplode(letters).alias("place", "base")).groupBy(*keys, "place", "base").agg(F.count("*").alias("c"))
    by_place = counts.groupBy(*keys, "place").agg(F.sum("c").alias("all"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same"))
    places = by_place.groupBy(*keys).agg(F.max("all").alias("n"), F.collect_list(F.when(F.col("place") > 0, F.struct("all", "same"))).alias("places"))  # one a letter of the longest barcode
    pairs = F.col("n") * (F.col("n") - 1) / 2
    d = F.aggregate(F.filter("places", lambda p: p["all"] == F.col("n")), F.lit(0.0), lambda s, p: s + pairs - p["same"])
    return places.select(*keys, F.when(F.col("n") > 1, F.ceil(F.round(d / pairs, 9)).cast("double")).otherwise(-1.0).alias("ave_ed"))


__all__ = ["average_distance", "both_ways", "build_edges", "build_nodes", "numbered", "settle", "with_components"]
