"""Reads derived from the supplied tables, by arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions.umi import number_to_umi

LENGTH = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read a line item: id, gene, cell, umi of skewed counts, and alignment-like columns."""
    li = table(spark, sf_dir, "lineitem")
    k = (F.col("l_partkey") % 40) * (F.col("l_orderkey") % 25)
    return li.select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 200000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"),
        F.col("l_suppkey").alias("gene"),
        (F.col("l_orderkey") % 7).alias("cell"),
        number_to_umi(k, LENGTH).alias("umi"),
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("_"), (F.col("l_orderkey") % 7).cast("string"), F.lit("_"), number_to_umi(k, LENGTH)).alias("qname"),
        (F.col("l_linenumber") % 3).alias("nh"),
        (F.col("l_partkey") % 50).alias("pos"),
        F.col("l_returnflag").alias("chrom"),
        (F.col("l_linestatus") == "O").alias("is_reverse"),
        (F.col("l_linenumber") % 2 == 1).alias("is_read1"),
        (F.col("l_quantity") % 5).cast("int").alias("tlen"),
        F.col("l_quantity").cast("int").alias("qual"),
    )


#: The same reads in SQL, as common table expressions.
READS_SQL = """
reads AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 200000 + l_partkey) * 10000 + l_suppkey AS id, l_suppkey AS gene, l_orderkey % 7 AS cell,
         'r' || l_orderkey || '_' || (l_orderkey % 7) || '_' || umi AS qname, umi, l_linenumber % 3 AS nh, l_partkey % 50 AS pos, l_returnflag AS chrom,
         l_linestatus = 'O' AS is_reverse, l_linenumber % 2 = 1 AS is_read1, (l_quantity % 5)::INTEGER AS tlen, l_quantity::INTEGER AS qual
  FROM (SELECT *, list_reduce(list_transform(generate_series(0, 5), lambda i: substr('ACGT', (((l_partkey % 40) * (l_orderkey % 25)) // (4 ** i)::BIGINT % 4)::INTEGER + 1, 1)), lambda x, y: x || y) AS umi FROM lineitem)
)"""

NODES_SQL = READS_SQL + """,
nodes AS (SELECT gene, umi, count(*) AS cnt, min(id) AS node FROM reads GROUP BY gene, umi),
arcs AS (SELECT a.gene, a.node AS src, b.node AS dst, a.cnt AS cnt_src, b.cnt AS cnt_dst, a.umi AS umi_src, b.umi AS umi_dst FROM nodes a JOIN nodes b ON a.gene = b.gene AND hamming(a.umi, b.umi) = 1),
edges AS (SELECT * FROM arcs WHERE src < dst)"""

#: Components: smallest node that each node reaches.
COMPONENTS_SQL = NODES_SQL + """,
reach AS (SELECT node, node AS low FROM nodes UNION SELECT arcs.dst, reach.low FROM reach JOIN arcs ON reach.node = arcs.src WHERE reach.low < arcs.dst),
cc AS (SELECT node, min(low) AS cc FROM reach GROUP BY node)"""
